import math
import random
import re
import zlib

import pytest

from quire.llm import toxicity as t


def by_rule(symbols):
    """The grammar's clause weight, straight from its description."""
    total = 0.0
    quoted = [t.MARK in symbols[:i] for i, x in enumerate(symbols) if x != t.MARK]
    symbols = [x for x in symbols if x != t.MARK]
    for i, x in enumerate(symbols):
        if x < t.THREAT:
            continue
        near = lambda kind, reach: any(symbols[j] == kind for j in range(max(0, i - reach), i))
        targeted = near(t.TARGET, 4) or t.TARGET in symbols[i + 1 : i + 5]
        base = (1.5 if targeted else 0.0) if x == t.THREAT else t.STRENGTHS[x - t.INSULT]
        total += base * (0.5 if near(t.NEGATION, 3) else 1) * (0.7 if quoted[i] or near(t.REPORT, len(symbols)) else 1) * (1.25 if targeted else 1)
    return total


def run(symbols):
    return t.clause_weight(symbols, t.addressed(), t.grammar())


def by_clauses(text, model):
    """The score of a text, clause by clause and word by word."""
    weights = []
    for line in (text or "").split("\n"):
        clause = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", line):
            clause += [t.MARK] * bool(re.match(r'\W*["“„«]\W*\w', word))
            clause.append(model.symbol(word.lower()))
            if re.search(r"[.,;:!?…|)\"”»]$", word):
                weights.append(by_rule(clause))
                clause = []
        weights.append(by_rule(clause))
    bias, strongest, total, number = model.weights
    z = bias + strongest * max(weights) + total * math.log1p(sum(weights)) + number * math.log1p(sum(w > 0 for w in weights))
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("learned", [False, True])
def test_query_against_clause_by_clause(spark, learned):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = t.train(docs, spark.read.parquet(f"{sf}/labels.parquet")) if learned else MODEL
    texts = ["you idiot\nyou\n\nidiot", "  you  are\tan \v idiot ; \r\n kill\n you", "not\tan idiot, kill you!", "“idiot ” kill", 'you are an "idiot" and („clown you', 'he "said" you «grumbling» idiot', "don’t be an idiot you", "x\x1cidiot", "\n.\n"]
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(texts, 10**6)), docs.schema))
    text_of = {r.doc_id: r.text for r in docs.collect()}
    rows = t.score(docs, model).collect()
    assert len(rows) == len(text_of) > 900
    for r in rows:
        assert r.score == pytest.approx(by_clauses(text_of[r.doc_id], model), abs=1e-9)


def test_composed_machine_against_the_rules():
    rnd = random.Random(2)
    for _ in range(2000):
        symbols = [rnd.choice([0, 0, 0, 0, *range(t.SYMBOLS)]) for _ in range(rnd.randint(0, 14))]
        assert run(symbols) == pytest.approx(by_rule(symbols))


MODEL = t.Model({"idiot": 3, "clown": 1}, {"grumb": 2}, (-2.0, 1.0, 0.5, 0.1))


def weight(text):
    return t.clause_features([text.encode()], MODEL, t.grammar())[0, 0]


def test_clauses_rather_than_words():
    plain = weight("idiot")
    assert plain == 3.5 and weight("grumbling") == 2.5 and weight("Grumb") == 2.5
    assert weight("you idiot") > plain > weight("he said idiot") > 0
    assert weight("not an idiot") < plain
    assert weight("not now. idiot") == plain  # the clause ends
    assert weight("you, idiot") == plain
    assert weight("kill the process") == 0 and weight("I will kill you") == weight("kill you") == weight("you I will kill") > 0
    assert weight("they will not kill you") < weight("they will kill you") and weight("kill it. you") == 0
    assert weight("nothing here") == 0 and weight("") == 0
    # marks of both kinds report, and don't hide what they quote
    assert weight("you are an \u201cidiot\u201d") == weight('you are an "idiot"') == weight('you are an ("idiot")') == pytest.approx(0.7 * weight("you are an idiot"))
    assert weight('such "a clever" "idiot"') == pytest.approx(plain * 0.7)
    # words are parted by any white space, clauses by marks and newlines alone
    assert weight("you\tare\tan\tidiot") == weight("you are  an idiot") == weight("you idiot") and weight("you\nidiot") == plain
    assert weight("not an  idiot") == weight("not an idiot") < plain
    assert weight("don\u2019t idiot") == weight("don't idiot") < plain


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = t.train(docs, labels)
    rows = t.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit >= 0.8 * sum(r.toxic for r in held)
    assert hit >= 0.8 * sum(r.predicted for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_odd_rows(spark):
    texts = [None, "", " \n ", "idiot", "idiot " * 5000, "x" * 60_000, "you are an idiot", "you are an idiot"]
    docs = spark.createDataFrame([(i, x, 2.0) for i, x in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in t.score(docs, MODEL).collect()}
    assert len(got) == len(texts) and got[0] == got[1] == got[2] == got[5] < 0.3 < got[6] == got[7]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = t.train(docs, none)
    assert not model.words and model.weights == t.PRIOR
    assert t.train(docs, spark.createDataFrame([(3, 1), (None, 0), (1, None)], "doc_id long, toxic int")).weights == t.PRIOR
    assert t.score(docs.limit(0), model).count() == 0
    lost = t.score(spark.createDataFrame([(None, "idiot")], "doc_id long, text string"), MODEL).first()
    assert lost.doc_id is None and lost.held_out is False and lost.score == got[3]


def test_learns_from_bounded_rows(spark):
    rows = [(i, ("word " * 20 + f"zorgle{'x' * (i % 3)} number{i} ") if i % 2 else f"plain text number{i} of words", i % 2) for i in range(400)]
    rows += [(1000 + i, "zorgle " * 20_000 + str(i), 0) for i in range(20)]  # too long to be learned from
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert "zorgle" in t.train(docs, labels, most_bytes=1000).words
    assert t.train(docs, labels, most_labelled=3).words == {}
