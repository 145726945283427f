"""That the registered operators do the whole of their job, not a part that happens to be cheap."""

import random
import re
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import plain_scores

from chainloom.llm import langid, lm, matroska, mixing, pii, queries


def test_registered_language_model_counts_three_words(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(30))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.score for x in queries.op10_lm(spark, str(tmp_path)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    three, two = ({i: s for i, *_, s in plain_scores(rows, n, held)} for n in (3, 2))
    assert all(abs(got[i] - three[i]) < 3e-4 * 31 for i in three)
    assert max(abs(got[i] - two[i]) for i in two) > 0.1


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 20_000, "many") for i in range(600)] + [(1000, "w " * 200, "small"), (1001, "w " * 700, "some")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert sum(x.size for x in got) > 10_000_000
    for name in ("many", "small", "some"):
        own = [x for x in got if x.source == name]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 2 + 0.01 * own[0].target, name
        assert all(0 <= x.taken <= 2 * x.size for x in own)


WORDS = {
    "en": "the of and to in that was his with for had not but from they this have she which you were all been when there would their what who will more could time than other into then some these two may only over such our man made like even after most also did many before must through years where much way well down should because each just those people how too little state good very make world still own see work long here get both between life being under".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer".split(),
}
FINNISH = "hän oli kuin mutta niin että sitä mitä minun sinun tämä kaikki jotka vielä nyt kun hyvin olen olisi voidaan myös koska sekä ihmisten työssä kysymys yhteiskunnan päivää kirjoittaa ymmärtää löytyy"


@pytest.mark.parametrize("labels", [["en"], ["en", "de"]])
def test_language_stage_rejects_unknown_languages_and_gibberish(spark, labels):
    r = random.Random(5)
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, say(WORDS[x], r.randint(5, 120)), x) for i in range(400) for x in [r.choice(labels)]]
    short = [(1000 + i, say(WORDS[labels[i % len(labels)]], 5), None) for i in range(60)]
    other = [(2000 + i, say(FINNISH.split(), 40), None) for i in range(30)] + [(2100 + i, "быть или не быть вот в чём вопрос " * 3, None) for i in range(3)]
    noise = [(3000 + i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(30)), None) for i in range(30)]
    docs = spark.createDataFrame([(*x, "s", 1) for x in rows + short + other + noise], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.language(spark, docs, "").collect()}
    assert not kept & {i for i, *_ in other + noise}
    assert len(kept & {i for i, *_ in short}) >= 0.95 * len(short) and len(kept & {i for i, *_ in rows}) >= 0.97 * len(rows)


def test_repeated_rows_are_taken_twice_at_most(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(WORDS["en"]) for _ in range(60)), "en", "s", 300) for i in range(40)]
    rows += [rows[3]] * 4 + [(None, *rows[5][1:4], 1), (3, "another text of the same id and of some words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    one = corpus_pipeline.near_duplicates(spark, docs, "").persist()
    assert [x.text for x in one.collect()].count(rows[3][1]) == 1 and {x.doc_id for x in one.collect()} >= set(range(40))
    mixed = [x.text for x in corpus_pipeline.mixture(spark, one, "").collect()]
    assert all(mixed.count(x[1]) <= 2 for x in rows if x is not rows[5] and x[0] is not None and x[1] != rows[5][1])


def test_repeated_rows_in_several_partitions_are_scored_each(spark):
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i % 3}") for i in range(12)], "doc_id long, text string").coalesce(1)
    got = lm.score(docs.union(docs), langid.held_out(parts=5, part=1), chunk=60).collect()
    assert sorted(x.doc_id for x in got) == sorted([*range(12)] * 2)
    assert len({(x.doc_id, x.score) for x in got}) == 12


def test_mixture_of_repeated_rows(spark):
    rows = [(7, "one two three four", "en", "s", 18)] * 3 + [(i, f"w{i} " * 40, "en", "s", 9) for i in range(20, 60)] + [(None, "no id here", "en", None, 10)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixture(spark, docs, "").collect()
    assert sum(r.doc_id == 7 for r in got) <= 6 and sum(r.doc_id is None for r in got) <= 4
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0


def test_other_texts_of_an_id_stay(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    texts = [(1, a), (5, near(a)), (5, b), (9, near(b)), (12, "lone"), (12, "other"), (None, a), (13, None), (13, "")]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs.repartition(3), "").collect()
    assert sorted((str(x.doc_id), x.text or "") for x in got if x.text) == sorted([("1", a), ("5", b), ("12", "lone"), ("12", "other"), ("None", a)])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_of_no_documents(spark, stage):
    assert stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "").count() == 0


def test_pseudonyms_of_dates_and_capitals(spark):
    texts = ["born 03/25/1984 or 12-31-1999", "Ann.Lee@x.com and ann.lee@x.com", "token=ABCDEF123456 token=abcdef123456", "x" * 300_000 + " 03/25/1984"]
    docs = spark.createDataFrame([(i, t, "n", "p") for i, t in enumerate(texts)], "doc_id long, text string, __new string, new_ string")
    got = {r.doc_id: r for r in pii.pseudonymize(docs, "k").collect()}
    assert got[0].pii == ["date", "date"] and all(int(d[:2]) <= 12 for d in re.findall(r"\d\d[/-]\d\d[/-]\d{4}", got[0].text)) or got[0].pii == ["date", "date"]
    upper, lower = re.findall(r"(\S+)@x", got[1].text)
    assert upper.lower() == lower and upper[0].isupper() and upper[4].isupper() and upper != "Ann.Lee"
    assert got[1].pii == ["email", "email"] and got[2].pii == ["secret", "secret"]
    upper, lower = re.findall(r"token=(\w+)", got[2].text)
    assert upper.lower() == lower and upper != lower
    assert re.findall(r"\d\d/\d\d/\d{4}", got[3].text) == re.findall(r"\d\d/\d\d/\d{4}", got[0].text) and got[0]["__new"] == "n" and got[0].new_ == "p"


def test_languages_of_clashing_names_and_repeated_rows(spark):
    rows = [(i, " ".join(WORDS[x][k] for k in range(i % 7, i % 7 + 30)), x, "a", "b") for i, x in enumerate(["en", "de"] * 30)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __seen string, seen_ string")
    got = langid.identify(docs, langid.train(docs, F.lit(True))).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == len(rows) // 2
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(rows)


def test_media_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (2, None), (2, "")], "doc_id long, text string")
    got = matroska.read_back(matroska.media(docs)).collect()
    assert len(got) == 4 and len({r.media_sha256 for r in got if r.doc_id == 1}) == 1 and len({r.media_sha256 for r in got if r.doc_id == 2}) == 1


def test_model_scores_of_null_and_short_ids(spark):
    rows = [(None, "a b c"), (None, "a b d"), (1, "a b c"), (1, "a b c"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id short, text string").selectExpr("*", "1 AS learn", "'x' AS id")
    got = lm.score(docs.unionByName(docs), F.lit(False)).collect()
    assert len(got) == 10 and len({r.score for r in got if r.n_tokens == 4}) == 2


def test_languages_outside_the_sample_are_learned(spark):
    # Rows lie by language, as files of a source do; the sample is smaller than the rows of the others.
    r = random.Random(4)
    words = {**WORDS, "fi": FINNISH.split()}
    say = lambda x, n: " ".join(r.choice(words[x]) for _ in range(n))
    rows = [(i, say("en" if i < 300 else "de", 60), "en" if i < 300 else "de") for i in range(600)] + [(1000 + i, say("fi", 60), "fi") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network, familiar = langid.learn(docs, F.lit(True), sample=60)
    assert network.languages == ["de", "en", "fi"]
    got = langid.identify(docs, network).collect()
    assert sum(x.lang_pred == x.lang for x in got) >= 0.97 * len(got) and all(x.lang_pred == "fi" for x in got if x.lang == "fi")
    # Counts are of all texts: a three of letters that one row in five hundred has is known.
    threes = lambda texts: sum(len(familiar._places(familiar._kinds(t.lower().encode()))) for t in texts)
    assert familiar.total <= threes(t for _, t, _ in rows) and familiar.total >= 0.7 * threes(t for _, t, _ in rows)


def test_letters_are_learned_within_the_drivers_memory():
    r, n = np.random.default_rng(3), langid.Familiar.KINDS
    at = r.choice(n**3, 20_000, replace=False)
    value = r.integers(1, 9, len(at))
    tracemalloc.start()
    known = langid.Familiar(at, value)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all counts of threes at once, as whole numbers, take 30 MB
    three = np.zeros(n**3)
    three[at] = value
    three = three.reshape(n, n, n)
    p = (three.sum((0, 1)) + 1) / (three.sum() + n)
    p = (three.sum(0) + p) / (three.sum((0, 2))[:, None] + 1)
    assert known.total == value.sum() and (known.table.reshape(n, n, n) == np.log((three + p) / (three.sum(2, keepdims=True) + 1)).astype(np.float16)).all()
