import base64
import random
import re
from collections import Counter

import zstandard

from quire.llm import quality_rules as q

CASES = [
    None, "", "   \n\t", "one", "a b c d e f g h i j", "a b c d e a b c d e x y z w", "x\nx\n\n \nx y\nx", "é ñ # $%& |<>* 漢字  nb em",
    "a b c d e " * 500, " ".join(f"w{i}" for i in range(5000)), "a b c d e f", "dup line here now\ndup line here now\n" * 3, "x" * 100_000,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_against_brute_force(spark, sf):
    rows = [(i, t, "clash") for i, t in enumerate(CASES * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    extra = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "lang n_words")
    both = docs.unionByName(extra)
    texts = {r.doc_id: r.text for r in both.collect()}
    got = q.judge(both).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (r.doc_id, texts[r.doc_id][:80])
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise_and_keep_prose(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("etaoinshr", k=rnd.randint(2, 8))) for _ in range(3000)]
    prose = " ".join(rnd.choices(words, k=1500))
    noise = base64.b85encode(rnd.randbytes(9000)).decode()
    noise = " ".join(noise[i : i + 8] for i in range(0, len(noise), 8))
    drum = " ".join(["tick", "tock", *"abc"] * 30 + words[:20])
    half = prose[:6000] + " " + " ".join(str(i % 7) * 6 for i in range(1500))
    docs = spark.createDataFrame([(1, prose), (2, noise), (3, drum), (4, half)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in q.judge(docs).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_clean_labelled_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    got = q.judge(spark.read.parquet(f"{sf}/documents.parquet").join(good, "doc_id"))
    rows = got.where("not base_failed").collect()
    assert sum(r.kept for r in rows) >= 0.995 * len(rows)


def test_planted_junk_at_several_lengths_and_shares():
    """Base64 and random words, alone and after prose; the tail after the last full chunk is judged too."""
    import string

    import pyarrow.parquet as pq

    rnd = random.Random(4)
    tables = {n: pq.read_table(f"/root/testdata/sf0.01/{n}.parquet").to_pydict() for n in ("documents", "labels")}
    good = {d for d, v in zip(tables["labels"]["doc_id"], tables["labels"]["quality"]) if v == 1}
    prose = " ".join(t for d, t in zip(tables["documents"]["doc_id"], tables["documents"]["text"]) if d in good and t).encode()

    def encoded(n):
        x = base64.b64encode(rnd.randbytes(n)).decode()
        return " ".join(x[i : i + 24] for i in range(0, len(x), 24)).encode()[:n]

    def words(n):
        return " ".join("".join(rnd.choices(string.ascii_letters + string.digits, k=rnd.randint(2, 10))) for _ in range(n)).encode()[:n]

    z = q.Compressor(q.Bands())
    for junk in (encoded, words):
        for n in (256, 300, 600, 1024, 2048, 3000, 4095, 9000):
            assert not z.verdict(junk(n))[-1], n
        for n in (2500, 4095, 6000, 51_000):
            assert not z.verdict(prose[: n * 4 // 10] + b" " + junk(n * 6 // 10))[-1], n
        assert z.verdict(prose[:20_000] + junk(2048) + prose[:700])[3] > 0
        assert z.verdict(prose[: 2 * 2048] + junk(600))[3] == 1
    starts = range(0, len(prose) - 60_000, 10_007)
    for n in (150, 300, 700, 1500, 3000, 5000, 50_000):
        assert sum(z.verdict(prose[a : a + n])[-1] for a in starts) >= 0.99 * len(starts), n


def test_empty_table(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_verdict(text):
    """(ratio of the whole, chunks, too repetitive, incompressible, whether the bands keep it), chunk by chunk."""
    z = zstandard.ZstdCompressor(level=3, write_content_size=False)
    ratio = lambda b: len(b) / max(1, len(z.compress(b)) - len(z.compress(b"")))
    n = len(text)
    least = lambda size: max(low for least, low in q.LOWEST if size >= least)
    most = 3.0 if n < 1024 else 3.2 if n < 4096 else 3.6 if n < 32768 else 4.5
    whole = ratio(text) if text else 0.0
    fits = least(n) <= whole <= most
    size = 2048 if n >= 4096 else 512
    chunks = [text[a : a + size] for a in range(0, n, size)]
    if len(chunks) > 1 and len(chunks[-1]) < 128:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    if len(chunks) < 2:
        return whole, 0, 0, 0, fits
    high = [c for c in chunks if ratio(c) > 3.0]
    low = [c for c in chunks if ratio(c) < least(len(c))]
    return whole, len(chunks), len(high), len(low), fits and sum(map(len, high + low)) <= 0.34 * n


def test_verdict_against_brute_force(spark):
    rnd = random.Random(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    prose = " ".join(r.text for r in docs.where("length(text) > 2000").limit(40).collect() if r.text)
    junk = base64.b64encode(rnd.randbytes(40_000)).decode()
    texts = [*CASES, *(prose[:n] for n in (127, 128, 511, 512, 513, 639, 640, 4095, 4096, 4100, 4224, 33_000))]
    texts += [prose[:a] + junk[:b] for a in (300, 2500, 9000) for b in (100, 400, 1500, 8000)] + [("ab " * a)[:b] + prose[:b] for a, b in ((100, 300), (2000, 2000), (9000, 9000))]
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], docs.schema))
    text_of = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    verdicts = set()
    for r in q.judge(docs).collect():
        whole, n, high, low, fits = brute_verdict(text_of[r.doc_id])
        assert (r.whole_ratio, r.n_chunks, r.n_chunks_repetitive, r.n_chunks_incompressible) == (whole, n, high, low), r.doc_id
        assert r.kept == (fits and not r.base_failed)
        verdicts.add((fits, high > 0, low > 0))
    assert len(verdicts) >= 5
