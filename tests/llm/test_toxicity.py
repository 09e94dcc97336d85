import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm.learning import CUT, labelled_texts
from helixframe.llm.queries import op8_toxicity
from helixframe.llm import toxicity as tox
from helixframe.llm.toxicity import CharModel, Language, Plain, Restorer, asked_for, fit, odd_tokens, readings, said, score, toxicity, viterbi

WORDS = "idiot stupid worthless clown moron the and house garden river table window paper little yellow summer people letter moment".split()


def model(words=WORDS):
    counts = Counter()
    for w in words:
        s = "^^" + w + "$"
        counts.update(s[i : i + 3] for i in range(len(s) - 2))
    return CharModel.of({k: 50 * n for k, n in counts.items()})


def char_model(docs):
    """The whole table of counts as one model, as a small corpus allows."""
    rows = Language.of(said(docs.select("text"))).grams.where(f"code >= {1 << 42}").collect()
    return CharModel.of_codes(np.array([r.code for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=np.int64))


@pytest.mark.parametrize(("written", "meant"), [("1d10t", "idiot"), ("st*u*p*i*d", "stupid"), ("cl0wn", "clown"), ("mooooron", "moron"), ("w0rthl3$$", "worthless"), ("i.d.i.o.t", "idiot"), ("garden", "garden"), ("2024", "2024")])
def test_restored_words(written, meant):
    assert Restorer(model())[written] == meant


def test_spaced_letters_become_a_word():
    assert Restorer(model()).words("the i d i o t house") == ["the", "idiot", "house"]


@pytest.mark.parametrize(
    ("written", "meant"),
    [("$tupid", "stupid"), ("!diot", "idiot"), ("idio+", "idiot"), ("(lown", "clown"), ("st" + "u" * 60 + "pid!", "stupid"), ("(garden!)", "garden"), ("garden!!!", "garden"), ("house,", "house"), ("$100", "100"), ("+1", "1"), ("s.t.u.p.i.d.", "stupid"), ("m0r0n!", "moron")],
)
def test_marks_at_the_ends_and_long_words(written, meant):
    assert Restorer(model())[written] == meant


@pytest.mark.parametrize(("written", "meant"), [("@sshole", "asshole"), ("a$$", "ass"), ("@$$", "ass"), ("@$$!", "ass")])
def test_words_of_few_letters(written, meant):
    assert Restorer(model([*WORDS, "ass", "asshole", "assess"]))[written] == meant


@pytest.mark.parametrize("text", ["the $ t u p 1 d house", "the s  t  u p  i d house", "the s\nt\nu\np\ni\nd house", "the s t u p i d\nhouse"])
def test_spaced_marks_and_any_white_space(text):
    assert Restorer(model()).words(text) == ["the", "stupid", "house"]


def test_spaced_words_are_told_apart():
    r = Restorer(model([*WORDS, "a", "ass", "assess"]))
    assert r.words("the a s s house") == ["the", "ass", "house"] and r.words("a  i d i o t") == ["a", "idiot"]
    assert r.words("s t u p i d\ni d i o t") == ["stupid", "idiot"]
    assert r.words("4 5 5") == ["4", "5", "5"] and r.words("house garden") == ["house", "garden"]


def test_long_tokens_are_linear():
    assert len(Restorer(model())["a1-" * 50_000]) > 1000


def test_viterbi_is_the_least_cost():
    lm = model()
    text, cost = viterbi(readings("m0r0n"), lm)
    options = [a + b + c + d + e for a in "m" for b in "o0" for c in "r" for d in "o0" for e in "n"]
    by = {w: lm.word_cost(w) + sum(4.0 if x == "0" else 1.0 if x != y else 0.0 for x, y in zip(w, "m0r0n", strict=True)) for w in options}
    assert text == min(by, key=by.get) and cost == pytest.approx(min(by.values()))


def test_language_model_counts_the_corpus(spark):
    docs = spark.createDataFrame([(1, "abc abc"), (2, None), (3, "abd, 12")], "doc_id long, text string")
    lm = char_model(docs)
    assert lm.tri["^^a"] == 3 and lm.tri["abc"] == 2 and lm.tri["bd$"] == 1


def test_language_model_keeps_every_trigram(spark):
    def words():
        for i in range(20_900 - 2):  # CJK words, one to four after each other
            yield "".join(chr(0x4E00 + (i * k + k) % 20_900) for k in (1, 3, 7, 11))

    want = {("^^" + w + "$")[i : i + 3] for w in words() for i in range(len(w) + 1)}
    assert len(want) > 100_000
    lm = char_model(spark.createDataFrame([(1, " ".join(words())), (2, "x" * 45)], "doc_id long, text string"))
    assert set(lm.tri) == want | {"^^x", "^xx", "xxx", "xx$"} and lm.tri["xxx"] == 43
    assert sum(lm.bi.values()) == sum(lm.tri.values()) and lm.size == len({t[2] for t in lm.tri}) + 1


def test_every_word_that_passes_has_a_weight(spark):
    letters = "abcdefghijklmnopq"
    toxic = ["x" + "".join(letters[i // 17**k % 17] + "y" for k in range(4)) for i in range(5_000)]
    rows = [(i, " ".join(toxic if i % 2 else ["plain", "words"] * 2_500)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert set(toxic) <= set(fit(docs, labels).weights)


@pytest.fixture(scope="module")
def corpus(spark):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(WORDS[5:]) for _ in range(rng.randint(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "1d10t", "moron", "m0r0n", "i d i o t", "clown"])
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    y = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity(docs, labels).collect() if r.held_out]
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= CUT) and 0 <= r.score <= 1 for r in held)


def test_held_out_labels_are_not_learned_from(spark, corpus):
    docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda df: sorted((r.doc_id, r.score) for r in toxicity(docs, df).collect())
    assert key(labels) == key(flipped)


def test_odd_documents(spark, odd_documents, corpus):
    m = fit(*corpus)
    got = score(odd_documents, m).collect()
    assert len(got) == odd_documents.count() and not any(r.predicted for r in got if not r.text)
    assert score(odd_documents.where("false"), m).count() == 0
    none = toxicity(odd_documents, corpus[1].where("false")).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)


def test_driver_table(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in op8_toxicity(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.85 * len(held)


def cheapest(lattice, lm):
    """The least cost over all readings, one by one: blanks end a word and begin one."""
    best = None
    for pick in product(*lattice):
        words = "".join(t for t, _ in pick).split(" ")
        cost = sum(c for _, c in pick) + sum(lm.word_cost(w) for w in words)
        best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("aidot01$@!.-s", min_size=1, max_size=7))
def test_decoder_equals_enumeration(token):
    lm = model()
    lattice = readings(token)
    text, cost = viterbi(lattice, lm)
    assert cost == pytest.approx(cheapest(lattice, lm))
    spaced = [opts for o in lattice for opts in (o, [("", 0.0), (" ", 0.0)])][:9]
    assert viterbi(spaced, lm)[1] == pytest.approx(cheapest(spaced, lm))


def test_scores_equal_a_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    m = fit(learned, labels)
    assert m.weights
    texts = {r.doc_id: r.text for r in docs.collect()}
    restore = Restorer(char_model(learned))
    for r in score(docs, m).collect():
        words = restore.words(texts[r.doc_id] or "")
        found = {}
        for w in words:
            if w in m.weights or "^" + w[:5] in m.weights:
                found.setdefault(w, [max(m.weights.get(w, 0.0), m.weights.get("^" + w[:5], 0.0)), 0])[1] += 1
        strong = sorted((w for w, _ in found.values()), reverse=True)
        total, hits = sum(w * n for w, n in found.values()), sum(n for _, n in found.values())
        x = [1.0, math.log1p(hits), strong[0] if strong else 0.0, sum(strong[:3]), total / math.sqrt(1 + len(words)), 10 * total / (10 + len(words))]
        z = sum(a * b for a, b in zip(x, m.coef, strict=True)) - m.cut + math.log(CUT / (1 - CUT))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z))))) and r.predicted == (r.score >= CUT)


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.createDataFrame([(i % 4, f"w{i} text") for i in range(400)], "doc_id long, text string")
    rows = labelled_texts(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int"), "toxic", None)
    assert sorted((r.doc_id, r.label, r.text) for r in rows.collect()) == [(i, i % 2, min(f"w{j} text" for j in range(i, 400, 4))) for i in range(4)]


ODD = ["1d10t", "m.0.r.0.n", "w0rthl3$$", "@$$!", "stuuuuupid", "x-1-y", "4ever", "don't", "a1-" * 400, "i d i o t", "$ t u p 1 d", "s s t u p i d", "4 5 5 6 a", "! d ! 0 t 1 2", "é.t.é", "日.本1", "aaa...bbb"]


@pytest.mark.parametrize("block", [1, 40, 50_000])
def test_blocks_decode_as_the_whole_model(spark, monkeypatch, block):
    monkeypatch.setattr(tox, "BLOCK", block)
    monkeypatch.setattr(tox, "MAX_TASKS", 5)
    docs = spark.createDataFrame([(i, " ".join(WORDS) + " été 日本 ever a ass") for i in range(50)] + [(99, " house ".join(ODD)), (100, None)], "doc_id long, text string")
    words = said(docs.select("text"))
    got = {r.token: r.words for r in Language.of(words).forms(odd_tokens(words)).collect()}
    restore = Restorer(char_model(docs))
    assert got == {t: restore.form(t) for t in got} and got["1d10t"] == ["idiot"] and got["i d i o t"] == ["idiot"]
    assert set(got) == {r.w for r in words.collect() if " " in r.w or Plain()[r.w] is None} and {"m.0.r.0.n", "$ t u p 1 d", "a1-" * 400} <= set(got)


class Asked(dict):
    """Counts that remember what was asked for."""

    def get(self, s, default=None):
        self[s] = 0
        return default


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text("aidot01$@!.-s", min_size=1, max_size=12), st.lists(st.sampled_from("aidot014$@!|+(s"), min_size=3, max_size=10).map(" ".join)), st.dictionaries(st.text("^aidots$014", min_size=3, max_size=3), st.integers(1, 99), max_size=30))
def test_no_other_count_is_asked_for(token, counts):
    lm, asked = CharModel.of(counts), Asked()

    class Spy(CharModel):
        def cost(self, before, c):
            asked.get(before + c), asked.get(before)
            return lm.cost(before, c)

    Restorer(Spy()).form(token)
    assert {tox.Counts.code(s) for s in asked} <= asked_for(token)


@settings(max_examples=200, deadline=None)
@given(st.text("aido1 0$\n.4", max_size=40))
def test_parts_are_the_words(text):
    restore = Restorer(model())
    words, odd = Plain().parts(text)
    for t, n in odd.items():
        for w in restore.form(t):
            words[w] += n
    assert words == Counter(restore.words(text))


def test_the_plan_sends_no_model_to_tasks(spark, corpus):
    docs, labels = corpus
    m = fit(docs, labels)
    assert m.__getstate__()["language"] is None and m.language.size > 10
    clash = docs.withColumn("__key", docs.doc_id).withColumn("score", docs.doc_id)
    got = toxicity(clash, labels)
    assert got.columns == ["doc_id", "text", "__key", "score", "predicted", "held_out"] and got.where("doc_id = __key").count() == 400


def test_copies_and_null_ids_are_scored_alike(spark, corpus):
    docs, labels = corpus
    more = docs.unionByName(docs.where("doc_id < 40").selectExpr("cast(NULL AS long) AS doc_id", "text")).unionByName(docs.where("doc_id = 5"))
    got = toxicity(more, labels).collect()
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add(r.score)
    assert len(got) == 441 and all(len(v) == 1 for v in by.values())
