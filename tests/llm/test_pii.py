import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pii


def brute(text):
    """The base kinds as their definitions say, with the plain patterns."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def added_brute(text, base):
    """The added kinds: every cue at every place, plain patterns from there, then every pair of spans compared."""
    spans = []
    low = "".join(c if c == "\u0130" else c.lower() for c in text)
    bounded = lambda a, b: not re.match(r"\w", text[a - 1 : a]) and not (text[b : b + 1].isalnum())
    for kind, cues in pii.CUES.items():
        for cue in cues:
            for m in re.finditer(f"(?={re.escape(cue)})", low):
                a, b = m.start(), m.start() + len(cue)
                rest, left = text[b:], text[:a]
                if kind == "email_text":
                    x = re.search(r"[A-Za-z0-9._%+-]+ ?$", left)
                    y = re.match(r" ?[A-Za-z0-9-]+(( ?[\[(][dD][oO][tT][\])] ?|\.)[A-Za-z0-9-]+)+", rest)
                    spans += [(x.start(), b + y.end(), kind)] if x and y else []
                elif kind == "login":
                    y = re.match(r"[^\s/@:?#]+:[^\s/?#]+(?=@)", rest)
                    spans += [(b, b + y.end(), kind)] if y else []
                elif kind == "secret":
                    if y := re.match(r"[\"']?[ \t]*[:=][ \t]*([\"']?)|[ \t]+([\"'])", rest):
                        mark, value = y[1] or y[2], rest[y.end() :]
                        line = value.split("\n")[0]
                        ends = [i for i, c in enumerate(line) if c == mark and (len(line[:i]) - len(line[:i].rstrip("\\"))) % 2 == 0] if mark else []
                        size = ends[0] if ends else len(re.match(r"\S*", value)[0])
                        spans += [(b + y.end(), b + y.end() + size, kind)] if size >= 8 else []
                elif kind == "account" and bounded(a, b):
                    y = re.match(r"\W{0,3}([A-Z]{2}[0-9]{2}( ?[A-Z0-9]{2,4}){3,8})(?![A-Za-z0-9])", rest)
                    if not (y and pii.iban(y[1])):
                        y = re.match(r" ?(?:[nN][uU][mM][bB][eE][rR]|[nN][uU][mM]|[iI][dD]|[nN][oO]|[nN][rR])?\b\.?[ \t]*[:#=]?[ \t\"']*([A-Z0-9]([-./]?[A-Z0-9]){4,})(?![A-Za-z0-9])", rest)
                        y = y if y and len(re.findall("[0-9]", y[1])) >= 4 else None
                    spans += [(b + y.start(1), b + y.end(1), kind)] if y else []
                elif kind == "address":
                    x = re.search(r"(?<!\w)[0-9]{1,5}[A-Za-z]? ([A-ZÄÖÜÉ][\w'-]{1,30} ){1,3}$", left[-120:])
                    if x and bounded(a, b):
                        spans.append((len(left) - len(left[-120:]) + x.start(), b, kind))
                    elif cue in ("straße", "strasse", "platz"):
                        x, y = re.search(r"(?<!\w)[A-ZÄÖÜ]\w{1,30}$", left[-32:]), re.match(r" [0-9]{1,4}[a-z]?(?!\w)", rest)
                        spans += [(a - len(x[0]) if x else a, b + y.end(), kind)] if y and (x or bounded(a, b)) else []
                    elif cue in ("rue", "calle", "avenida") and bounded(a, b):
                        y = re.match(r"( (de|la|le|du|des|del|los|las))*( [A-ZÄÖÜÉÁÍÓÚÑ][\w'-]{1,30}){1,3},? [0-9]{1,5}(?!\w)", rest)
                        spans += [(a, b + y.end(), kind)] if y else []
    kept = []
    for a, b, kind in sorted(set(spans), key=lambda x: (x[0], -x[1], pii.KINDS.index(x[2]))):
        if not any(a < d and c < b for _, c, d in kept) and not any(c <= a and b <= d for _, c, d in base):
            kept.append((kind, a, b))
    return sorted(kept, key=lambda x: (pii.KINDS.index(x[0]), x[1]))


cues = st.sampled_from([c for cs in pii.CUES.values() for c in cs] + ["Account No. 12345678", "IBAN DE89 3704 0044 0532 0130 00", "token='abcdefgh'", " jo [at] x [dot] org", "ftp://u:p@h", "12 Old Mill Road", "Hauptstraße 12", "rue de la Paix 5", " ", "=", ":", "'", "1.2.3.4", "a@b.co", "AB12345", " 77 ", "Xyz ", "İ", "é", "\n", "_", "API_KEY: ", "TAX id ", "\\", '"', "p!$w@", "://b:s!c@db.ex.com"])


@settings(max_examples=400, deadline=None)
@given(st.lists(cues, max_size=12).map("".join))
def test_added_kinds_against_every_place(text):
    base, added = pii.find(text)
    assert added == added_brute(text, base)


def test_corpus_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kinds = set()
    for r in docs.collect():
        base, added = pii.find(r.text or "")
        assert base == brute(r.text or "") and added == added_brute(r.text or "", base)
        kinds |= {k for k, _, _ in base + added}
    assert len(kinds) >= 3


def test_long_local_parts_and_hosts():
    text = "a" * 300 + " [at] " + "b" * 70 + " [dot] " + ".".join("c" * 9) + " end"
    assert found(text) == [("email_text", text[:-4])]


def test_long_texts_in_linear_time():
    import time

    line = "mail a@b.co or jo [at] x [dot] org, token='abcdefgh', 1.2.3.4 and IBAN DE89 3704 0044 0532 0130 00 at 12 Old Mill Road\n"
    start = time.process_time()
    base, added = pii.find(line * 45_000)  # 5 MB
    assert len(base) == 2 * 45_000 and len(added) == 4 * 45_000
    assert time.process_time() - start < 30


pieces = st.sampled_from(list("ab1.@- +()\n%é") + ["4242 4242 4242 4242", "4242424242424242", "1.2.3.4", "255.256.1.1", "000255.0.0.1", "a@b.c", "@@", "x.y@z-1.co.uk", "+1 (555) 010-9999", "..", "0" * 15, "😀", "１２"])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=30).map("".join))
def test_base_kinds_against_the_plain_patterns(text):
    base, added = pii.find(text)
    assert base == brute(text)
    taken = sorted((a, b) for _, a, b in base)
    spans = sorted((a, b) for _, a, b in added)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert not any(a <= c and d <= b for a, b in taken for c, d in spans)


def test_query_rows(spark, sf):
    texts = [None, "", "nothing here", "a@b.co and a@b.co", "1" * 20_000, "a" * 50_000 + "@", "x@y.z " * 3000]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100 doc_id", "text", "lang spans")
    docs = docs.unionByName(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "doc_id long, text string, spans string"))
    whole = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pii.detect(docs).collect()
    assert len(got) == len(whole)
    for r in got:
        base = brute(whole[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.BASE]
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.spans.split(",")) | {""}
    assert sum(r.n_card for r in got) > 3


def found(text):
    base, added = pii.find(text)
    return [(k, text[a:b]) for k, a, b in base + added]


def test_added_kinds():
    assert found("write to jane.doe [at] mail [dot] example [dot] org now") == [("email_text", "jane.doe [at] mail [dot] example [dot] org")]
    assert found("ftp://bob:hunter2@files.example.com/x")[-1] == ("login", "bob:hunter2") or ("email", "hunter2@files.example.com") in found("ftp://bob:hunter2@files.example.com/x")
    assert found("IBAN: DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN: DE88 3704 0044 0532 0130 00.") != [("account", "DE88 3704 0044 0532 0130 00")]
    assert found("Passport no. X1234567 ok") == [("account", "X1234567")]
    assert found('token = "04dbebab91ab85687d33"') == [("secret", "04dbebab91ab85687d33")]
    assert found("lives at 12 Old Mill Road in") == [("address", "12 Old Mill Road")]
    assert found("Hauptstraße 12 und") == [("address", "Hauptstraße 12")]
    assert found("the account of a road was a secret passport to rue") == []


def test_values_run_to_their_end():
    for n in (8, 256, 257, 1000, 40_000):
        assert found("token = " + "aB3-" * (n // 4) + "x" * (n % 4) + "\nnext") == [("secret", "aB3-" * (n // 4) + "x" * (n % 4))]
        assert pii.redact_text("password=" + "q" * n + " end") == "password=<SECRET> end"
    for n in (5, 128, 129, 5000):
        assert found(f"ftp://{'u' * n}:{'p!' * n}@host/x") == [("login", f"{'u' * n}:{'p!' * n}")]
    assert found("token=token=abcdefgh ok") == [("secret", "token=abcdefgh")]
    assert found("token=1.2.3.4/token=abcdefgh ok") == [("ip", "1.2.3.4"), ("secret", "1.2.3.4/token=abcdefgh")]
    assert found("token: short") == []


def test_cues_in_every_case():
    for cue in ("Tax ID", "Customer ID", "Social Security", "sOCIAL sECURITY", "Ssn", "IBan"):
        assert found(f"{cue} 12345678 ok") == [("account", "12345678")], cue
    for cue in ("API_Key", "Api_key", "PassWord", "ApiKey"):
        assert found(f"\u0130 {cue}='abcdefgh'") == [("secret", "abcdefgh")], cue


def test_many_cues_in_one_value_take_linear_time():
    import time

    start = time.process_time()
    assert found("token=" * 200_000) == [("secret", "token=" * 199_999)]
    assert found("://u:p" * 200_000) == []
    assert time.process_time() - start < 20


def test_redaction_keeps_the_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", "en", 15), (2, None, "en", 0), (3, "plain", None, 5)], "doc_id long, text string, lang string, n_chars long")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: ("mail <EMAIL> now", 16), 2: (None, None), 3: ("plain", 5)}


def test_empty_table(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction_leaves_nothing_of_a_value():
    said = pii.redact_text
    assert said("password=Sup3r!Secret#2024 end") == "password=<SECRET> end"
    assert said("token: abc$defghijk") == "token: <SECRET>"
    assert said("token: abcdefgh$rest and") == "token: <SECRET> and"
    assert said("https://bob:s3cr!et@db.example.com/x") == "https://<LOGIN>/x"
    assert said("ftp://bob:p@ss@w!rd@host/x") == "ftp://<LOGIN>@host/x"
    assert said('{"api_key": "one two three\\" four", "n": 1}') == '{"api_key": "<SECRET>", "n": 1}'
    assert said("password = 'it has spaces' ok") == "password = '<SECRET>' ok"
    assert said("password = 'never closed\nnext line'") == "password = 'never closed\nnext line'"  # five characters
    assert said("token=" + "aB1!$" * 80 + " ok") == "token=<SECRET> ok"
    assert said("account no. " + "AB12" * 30 + " ok") == "account no. <ACCOUNT> ok"


printable = st.text(alphabet=[chr(c) for c in range(0x21, 0x7F)], min_size=8, max_size=400)


@settings(max_examples=300, deadline=None)
@given(printable, st.sampled_from(["password=", "token: ", "API_Key = ", "secret:"]))
def test_values_of_any_printable_characters(value, cue):
    if value[0] not in "\"'":
        assert pii.redact_text(f"a {cue}{value}\nb") == f"a {cue}<SECRET>\nb"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(0x21, 0x7F) if chr(c) not in "/?#:"], min_size=1, max_size=60), st.sampled_from(["db.example.com", "localhost"]))
def test_passwords_in_urls(value, host):
    got = pii.redact_text(f"see https://bob:{value}@{host}/x ok")
    assert got in (f"see https://<LOGIN>@{host}/x ok", "see https://<LOGIN>/x ok")
