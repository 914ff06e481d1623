"""Text normalisation as Column -> Column functions. All are plain expressions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as a space or as nothing.
AS_SPACE = " ​‌‍  ﻿\t"
RUN_SPACES = "   "
RUN_NOTHING = "​‌‍﻿"
#: Words that stay in lower case inside a title, and acronyms.
SMALL_WORDS = "a an the and but or for nor on at to by in of up as is".split()
TITLE_ACRONYMS = "RNA DNA PCR RT FISH ISH FACS GFP RFP YFP CFP ATAC HCR CRISPR LNP IHC IF PBS BSA EDTA DMSO".split()
SLUG_ACRONYMS = "RNA DNA PCR RT FISH ISH FACS GFP RFP YFP CFP MRNA GRNA SGRNA CRRNA SIRNA SHRNA CHIP ATAC HCR SMFISH CRISPR LNP IHC IF PBS BSA EDTA DMSO ETOH".split()
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "mL uL mM uM nM pH e.g i.e vs al Fig Tab Ref Sec approx min max vol conc".split()
#: The months; three letters stand for each, too.
MONTHS = "january february march april may june july august september october november december".split()
DASH = "—"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of an expression that f uses more than once: it is evaluated once a row, whatever the optimizer copies around it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_whitespace(c: Column) -> Column:
    """Special spaces become plain ones, runs of spaces one, the ends are stripped; line breaks inside stay; null is empty."""
    plain = F.translate(F.coalesce(c, F.lit("")), AS_SPACE, " " * len(AS_SPACE))
    return strip(F.regexp_replace(plain, " {2,}", " "))


def normalize_text(c: Column, keep_punctuation: bool = True) -> Column:
    out = normalize_whitespace(c)
    if keep_punctuation:
        return out
    return F.replace(F.translate(out, "‘’“”–", "''\"\"-"), F.lit("…"), F.lit("..."))


def strip_markers(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\*\*(.+?)\*\*", "$1"), r"_(.+?)_", "$1")


def normalize_cross_references(c: Column) -> Column:
    return F.regexp_replace(c, r"\b[Ss]ec(?:tion|\.)\s*(\d+(?:\.\d+)*)\b", "Section $1")


def normalize_centrifuge_units(c: Column) -> Column:
    for unit in (r"\*g\*", "_g_", r"[xX]\s*g\b"):
        c = F.regexp_replace(c, rf"(\d)\s*{unit}", "$1 × g")
    return c


def normalize_temperature_units(c: Column) -> Column:
    c = F.regexp_replace(c, r"(\d)\s*[oO]\s*([CF])\b", "$1°$2")
    return F.regexp_replace(c, r"(\d+(?:\.\d+)?)\s*°\s*([CF])\b", "$1 °$2")


def normalize_units(c: Column) -> Column:
    """Cross-references, then centrifuge units, then temperatures: the reader's order."""
    return normalize_temperature_units(normalize_centrifuge_units(normalize_cross_references(c)))


#: What a callout of each class may begin with.
CALLOUT_LABELS = {"caution": "important|warning|caution", "critical": "critical|crucial", "tip": "tip", "note": "note"}


def strip_callout_prefix(c: Column) -> Column:
    """Without a callout's label and the mark behind it."""
    return strip(F.regexp_replace(c, rf"(?i)^(?:{'|'.join(CALLOUT_LABELS.values())})\s*[:\-–—]\s*", ""))


def clean_title(c: Column) -> Column:
    return F.regexp_replace(normalize_whitespace(strip_markers(c)), r"[:;.,]+$", "")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.length(c))))


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: F.length(w) > 0)


def title_case(c: Column) -> Column:
    """Acronyms in capitals, small words inside in lower case, all others capitalised."""
    ws = words(c)

    def one(w: Column, i: Column) -> Column:
        edge = (i == 0) | (i == F.size(ws) - 1)
        return F.when(F.upper(w).isin(TITLE_ACRONYMS), F.upper(w)).when(~edge & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(capitalize(w))

    return F.array_join(F.transform(ws, one), " ")


def title_slug(c: Column) -> Column:
    """Capitalised words joined by hyphens, cut at 60 characters, at a hyphen beyond the 21st if there is one."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[\s\-—–]+", " "), r"(?U)[^\w\s]", "")
    slug = F.array_join(F.transform(words(plain), lambda w: F.when(F.upper(w).isin(SLUG_ACRONYMS), F.upper(w)).otherwise(capitalize(w))), "-")
    head = F.left(slug, F.lit(60))
    last = F.length(head) - F.instr(F.reverse(head), "-")  # place from 0 of the last hyphen
    cut = F.when(F.contains(head, F.lit("-")) & (last > 20), F.left(head, last)).otherwise(head)
    return F.when(F.length(slug) == 0, "Untitled-Protocol").when(F.length(slug) > 60, cut).otherwise(slug)


def output_filename(section: Column, title: Column, version: Column) -> Column:
    prefix = F.when(F.length(F.coalesce(section, F.lit(""))) > 0, F.concat(section, F.lit("-"))).otherwise("")
    return F.concat(prefix, title_slug(title), F.lit("_v"), F.replace(version, F.lit("."), F.lit("_")), F.lit(".docx"))


def stem_title(path: Column) -> Column:
    """A title from a file's name."""
    return title_case(F.translate(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), "_-", "  "))


def footer_title(c: Column) -> Column:
    return F.when(F.length(c) > 40, F.concat(F.left(c, F.lit(37)), F.lit("…"))).otherwise(c)


def header_line(number: Column, name: Column, series: str = "Collected Procedures") -> Column:
    return F.concat(F.lit("SECTION "), number, F.lit(f" {DASH} "), F.upper(name), F.lit(f" · {series}"))


def byline(author: Column, version: Column, date: Column) -> Column:
    return F.concat_ws(" · ", author, F.concat(F.lit("Version "), version), F.concat(F.lit("Last updated "), date))


def footnote_refs(c: Column) -> Column:
    """Distinct numbers of [n] and, after those are gone, of (n) before a space or the end; sorted."""
    first = F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1))
    second = F.regexp_extract_all(F.regexp_replace(c, r"\[\d+\]", ""), F.lit(r"\((\d+)\)(?=\s|$)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.concat(first, second), lambda x: x.try_cast("long"))))


def without_footnote_refs(c: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(F.regexp_replace(c, r"\[\d+\]", ""), r"\(\d+\)(?=\s|$)", ""))


def sentences(c: Column) -> Column:
    """Split after . ! ? and white space before a capital, but not after an abbreviation."""
    guard = "".join(rf"(?<!\b{a})" for a in (x.replace(".", r"\.") for x in ABBREVIATIONS))
    return F.split(c, rf"(?<=[.!?]){guard.replace(')', '[.])')}\s+(?=[A-Z])")


def normalize_date(c: Column) -> Column:
    """DD/MM/YYYY of the first day-month-year in digits (unchecked), else of [day] month-name year; else null."""
    numeric = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
    named = rf"(?i)(\d{{1,2}}\s+)?({'|'.join(f'{m[:3]}(?:{m[3:]})?' if m[3:] else m for m in MONTHS)})\s+(\d{{4}})"
    part = lambda pattern, g: F.regexp_extract(c, pattern, g)
    two = lambda x: F.lpad(x, 2, "0")
    day = F.trim(part(named, 1))
    month = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.lower(F.left(part(named, 2), F.lit(3)))).cast("string")
    return F.when(F.rlike(c, F.lit(numeric)), F.concat_ws("/", two(part(numeric, 1)), two(part(numeric, 2)), part(numeric, 3))).when(
        F.rlike(c, F.lit(named)), F.concat_ws("/", two(F.when(day == "", "1").otherwise(day)), two(month), part(named, 3))
    )


def valid_date(c: Column) -> Column:
    """Whether dd/mm/yyyy with a month of 1-12 and a day of 1-31; impossible days pass."""
    number = lambda a: F.substring(c, a, 2).try_cast("int")
    return F.rlike(c, F.lit(r"^\d{2}/\d{2}/\d{4}$")) & F.coalesce(number(4).between(1, 12) & number(1).between(1, 31), F.lit(False))


def inline_tokens(c: Column) -> Column:
    """array<struct<text, bold, italic>> of **bold**, _italic_ and _**both**_; unclosed marks are text."""
    pieces = F.regexp_extract_all(c, F.lit(r"_\*\*.+?\*\*_|\*\*.+?\*\*|_.+?_|[^*_]+|[*_]"), F.lit(0))

    def one(t: Column) -> Column:
        both, bold, italic = (F.rlike(t, F.lit(p)) for p in (r"^_\*\*.+\*\*_$", r"^\*\*.+\*\*$", r"^_.+_$"))
        inner = lambda k: F.substring(t, F.lit(k + 1), F.length(t) - 2 * k)
        return F.struct(F.when(both, inner(3)).when(bold, inner(2)).when(italic, inner(1)).otherwise(t).alias("text"), (both | bold).alias("bold"), (both | (italic & ~bold)).alias("italic"))

    return F.when(F.length(c) == 0, F.array(F.struct(F.lit("").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))).otherwise(F.transform(pieces, one))


def inline_code_tokens(c: Column) -> Column:
    """array<struct<text, bold, italic, code>>: inline_tokens() with `code` spans first."""
    pieces = F.regexp_extract_all(c, F.lit(r"`[^`]+`|_\*\*[^`]+?\*\*_|\*\*[^`]+?\*\*|_[^`]+?_|[^*_`]+|[*_`]"), F.lit(0))

    def one(t: Column) -> Column:
        code = F.rlike(t, F.lit("^`[^`]+`$"))
        plain = F.get(inline_tokens(t), F.lit(0))
        return F.struct(F.when(code, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(plain["text"]).alias("text"), (~code & plain["bold"]).alias("bold"), (~code & plain["italic"]).alias("italic"), code.alias("code"))

    return F.transform(pieces, one)


def code_lines(code: Column, language: Column) -> Column:
    """A code block's lines, blank ones as one space, with a `# language` line in front if there is a language."""
    lines = F.transform(F.split(code, "\r?\n"), lambda x: F.when(F.length(strip(x)) == 0, " ").otherwise(x))
    return F.when(F.length(F.coalesce(language, F.lit(""))) > 0, F.concat(F.array(F.concat(F.lit("# "), language)), lines)).otherwise(lines)


def overview_paragraphs(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n+"), strip), lambda x: F.length(x) > 0)
    return F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(c) / F.lit(3.5)))


def pad_cells(cells: Column, width: int) -> Column:
    """Blank cells become a dash, rows are filled with dashes or cut to the width."""
    filled = F.transform(cells, lambda x: F.when(F.length(strip(x)) == 0, DASH).otherwise(strip(x)))
    return F.slice(F.concat(filled, F.array_repeat(F.lit(DASH), width)), 1, width)


def author(c: Column, aliases: dict[str, str] | None = None, default: str = "Unattributed") -> Column:
    """Blank or generic office names give the default; a text that matches an alias's pattern gives its name; else the cleaned text."""
    out = normalize_whitespace(c)
    out = F.when(F.rlike(strip(c), F.lit(r"(?i)^(microsoft office user|windows user|user|owner|author|admin)$")), default).otherwise(out)
    for pattern, name in (aliases or {}).items():
        out = F.when(F.rlike(c, F.lit(pattern)), name).otherwise(out)
    return F.when(c.isNull() | (F.length(strip(c)) == 0), default).otherwise(out)
