"""Driver-side checks of what an installation can reach. A probe answers; it never raises."""

from __future__ import annotations

import json
import shutil
import subprocess
from urllib import request


def server(url: str, timeout: float = 5.0) -> tuple[bool, list[str]]:
    """(whether a model server answers, the names of its models), from its list of models."""
    try:
        with request.urlopen(f"{url.rstrip('/')}/api/tags", timeout=timeout) as r:
            return True, [m.get("name", "") for m in json.loads(r.read()).get("models", [])]
    except (OSError, ValueError, AttributeError):
        return False, []


def command(name: str, *arguments: str, timeout: float = 10.0) -> str | None:
    """The first line that a command says about its version; null if it isn't there or fails."""
    found = shutil.which(name)
    if not found:
        return None
    try:
        done = subprocess.run([found, *(arguments or ("--version",))], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return (done.stdout or done.stderr).strip().split("\n")[0] if done.returncode == 0 else None


def converter(program: str = "soffice", timeout: float = 120.0):  # noqa: ANN201  a function of bytes
    """A function from the bytes of a .doc file to those of a .docx file by an external program, for ooxml.read_files(). It raises what goes wrong."""

    def convert(data: bytes) -> bytes:
        import tempfile
        from pathlib import Path

        with tempfile.TemporaryDirectory() as folder:  # a task's own, gone when it ends
            source = Path(folder) / "in.doc"
            source.write_bytes(data)
            done = subprocess.run([program, "--headless", "--convert-to", "docx", "--outdir", folder, str(source)], capture_output=True, text=True, timeout=timeout)
            made = Path(folder) / "in.docx"
            if done.returncode or not made.exists():
                raise RuntimeError(f"conversion failed: {done.stderr.strip()[:300]}")
            return made.read_bytes()

    return convert
