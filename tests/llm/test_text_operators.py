"""Token, media, URL, mixing, language and language-model operators against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from chainloom.llm import bpe, langid, lm, matroska, mixing, pieces, sstable, urls

P = pytest.importorskip("public_tokenizers")
RANKS, JSON, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.PATTERN
TEXTS = [None, "", " ", "\n", "a", "  two  spaces ", "tab\there", "It's we'll   they're\n\n\tDone.", "naïve Straße été niño", "<|endoftext|> is text", "x" * 5000, "ab " * 3000, "日本語 テキスト", "\u00a0nb\u00a0 space", "ɐ ɐɐ", "12 345 6!? ...", "\x00\x01 z", "emoji 😀 ok", "Ⅷ ½ x²", "end "]


def docs_of(spark, texts, **more):
    rows = [(i, t, "x", *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string" + "".join(f", {k} string" for k in more))


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(RANKS)


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_is_word_by_word_encoding(merges, reference):
    words = [b"", b"a", b" hello", b"aaaaaaaaaa", "été".encode(), b"unbelievable" * 30, bytes(range(256)).decode("latin-1").encode()]
    for word, ids in zip(words, merges.replay(words), strict=True):
        assert ids == reference._encode_single_piece(word) if word else ids == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é'sß1 \n\t.,日😀\u00a0")), max_size=60), max_size=3))
def test_pieces_are_the_matches_of_the_pattern(texts):
    find = regex.compile(PATTERN).findall
    found = pieces.split(pa.array(texts, pa.string()), find)
    words = found.words.to_pylist()
    rows = np.split(found.numbers, np.cumsum(found.sizes)[:-1]) if texts else []
    assert [[words[k] for k in row] for row in rows] == [find(t) for t in texts]
    assert len(set(words)) == len(words)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é'sß1 \n\t.,日😀\u00a0<|endoftext|>")), max_size=60))
def test_texts_encode_as_by_the_library(text):
    ids, offsets = sstable.encoder(JSON, PATTERN)(pa.array([text, "<|endoftext|>", text + " <|endoftext|>x"]))
    want = [plain_library().encode(t, add_special_tokens=False).ids for t in (text, "<|endoftext|>", text + " <|endoftext|>x")]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


@lru_cache(maxsize=1)
def plain_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aab' theino.é日")), min_size=1, max_size=30), max_size=20))
def test_replay_over_many_words(merges, reference, words):
    raw = [w.encode() for w in words]
    assert merges.replay(raw) == [reference._encode_single_piece(w) for w in raw]


def test_code_table_starts_anew_beyond_its_bounds():
    def encode(words):
        n = np.array([len(w) for w in words], np.int64)
        return np.cumsum(n) - n, n, np.repeat(n, n).astype(np.uint32)

    table = pieces.Codes(encode, most=3)
    for words in (["a", "bb"], ["bb", "ccc", "a", "dddd"], ["a", "ee"]):
        starts, sizes, flat = table(words)
        assert [flat[a : a + n].tolist() for a, n in zip(starts, sizes)] == [[len(w)] * len(w) for w in words]
    assert len(table.known) == 2


def test_bpe_round_trip(spark, reference):
    for r in bpe.round_trip(docs_of(spark, TEXTS), RANKS, PATTERN).collect():
        text = TEXTS[r.doc_id] or ""
        ids = np.array(reference.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs_of(spark, TEXTS), RANKS, PATTERN, chunk=60), RANKS)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(docs_of(spark, TEXTS).limit(0), RANKS, PATTERN).count() == 0


def test_shards_hold_what_the_library_encodes(spark, tmp_path):
    from pyarrow import fs
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    rows = [(i * 3 - 10, x) for i, x in enumerate(TEXTS)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = sstable.write_shards(docs, f"file://{tmp_path}/s", JSON, PATTERN, 2)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    start = 0
    want = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    found = 0
    for m in manifest.collect():
        store, path = fs.FileSystem.from_uri(m.path)
        with store.open_input_file(path) as file:
            reader = sstable.Reader(file)
            found += len(reader.get(sstable.key_of(5)))
            assert reader.get(sstable.key_of(10**9)) == []
    assert found == 2 + sum(i == 5 for i, _ in rows[: len(TEXTS)])
    assert sstable.shard_round_trip(docs.limit(0), JSON, PATTERN).count() == 0


def test_shard_blocks_and_lookup(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    at = tmp_path / "x.sst"
    with at.open("wb") as out:
        w = sstable.Writer(out)
        for i in range(0, 400, 2):
            w.add(sstable.key_of(i), np.arange(i % 7 + (70000 if i == 8 else 0), dtype=np.uint32))
        w.close()
    with at.open("rb") as file:
        reader = sstable.Reader(file)
        assert len(reader.blocks) > 10 and reader.n_keys == 200
        assert [len(reader.get(sstable.key_of(i))) for i in range(400)] == [1 - i % 2 for i in range(400)]
        assert len(reader.get(sstable.key_of(8))[0]) == 70001


@pytest.mark.parametrize("kind", ["", "xiph"])
@pytest.mark.parametrize("size", [0, 1, 64, 512, 513, 4096, 5000, 32768, 32769, 100_001])
def test_matroska_round_trip(size, kind):
    payload = random.Random(size).randbytes(size)
    data = matroska.mux(payload, kind)
    found = matroska.parse(data)
    assert matroska.demux(data) == payload
    assert [c for _, c in found.cues] == found.clusters
    assert all(p.timestamp == sum(q.length for q in found.packets[:i]) for i, p in enumerate(found.packets))


def test_matroska_reads_block_groups_unknown_sizes_and_odd_elements():
    block = matroska.element(matroska.BLOCK, matroska.vint(3) + b"\xff\xfe\x00" + b"data")
    group = matroska.element(matroska.BLOCK_GROUP, block + matroska.element(0x9B, b"\x05"))
    body = matroska.element(matroska.TIMESTAMP, b"\x64") + matroska.element(0xEC, b"void") + group
    unknown = matroska._id(matroska.CLUSTER) + b"\xff" + body
    data = matroska._HEAD + matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + matroska._TRACKS + unknown + unknown
    found = matroska.parse(data)
    assert [(p.cluster, p.track, p.timestamp, data[p.start : p.start + p.length]) for p in found.packets] == [(0, 3, 98, b"data"), (1, 3, 98, b"data")]
    for bad in (b"", b"nothing", matroska.mux(b"cut short")[:-3]):
        with pytest.raises(ValueError):
            matroska.parse(bad)


def test_media_table(spark):
    docs = docs_of(spark, TEXTS, data="y")
    for r in matroska.read_back(matroska.media(docs)).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    table = matroska.packets(matroska.media(docs), "doc_id", "data").collect()
    assert sum(p.length for p in table) == sum(len(matroska.padded((t or "").encode())) for t in TEXTS)
    assert matroska.read_back(matroska.media(docs.limit(0))).count() == 0


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme casino": ("", "", None, "block"), "http://A.Org/x?q#f": ("a.org", "/x", "org/", "allow"),
        "http://www.example.org/es/1": ("www.example.org", "/es/1", "example.org/es/", "block"), "http://example.org/en/10": ("example.org", "/en/10", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://casino.com/fr/": ("casino.com", "/fr/", "com/fr/", "allow"), "https://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://casinos.net/": ("casinos.net", "/", None, "allow"), "http://my-CASINO.net": ("my-casino.net", "", None, "block"), "http://free.net/free": ("free.net", "/free", None, "allow"),
        "http://free.net/win?x": ("free.net", "/win", None, "block"), "http://org/a": ("org", "/a", "org/", "allow"), "http://x.org": ("x.org", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    rows = list(cases)
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert {rows[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in got} == cases


def test_urls_with_other_vocabularies_and_tables(spark):
    rows = [(1, "http://a.net/Foo-bar"), (1, "http://a.net/Foo-bar"), (2, "http://a.net/foo"), (None, "http://a.net/baz"), (3, "http://a.net/" + "x/" * 50_000 + "bar/foo"), (4, None)]
    pages = spark.createDataFrame(rows, "page_id short, url string").selectExpr("*", "'own' AS host", "7 AS soft_hits", "1 AS verdict")
    terms = urls.vocabulary_of(spark.createDataFrame([("FOO", 2), ("foo", 1), ("bar", 2), ("baz", 9), (None, 3), ("", 9)], "term string, weight int"))
    got = sorted(((r.page_id or 0, r.verdict, r.strict_hits, r.soft_hits, r.soft_weight) for r in urls.judge_urls(pages, terms=terms).collect()))
    assert got == [(0, "block", 1, 0, 0), (1, "block", 0, 2, 4), (1, "block", 0, 2, 4), (2, "allow", 0, 1, 2), (3, "block", 0, 2, 4), (4, "allow", 0, 0, 0)]
    assert urls.judge_urls(pages.limit(0)).count() == 0


def naive_seats(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))):
        i = max((i for i in range(len(votes)) if got[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague_is_highest_quotients(parties, seats):
    votes, caps = [float(v) for v, _ in parties], [c for _, c in parties]
    assert mixing.sainte_lague(votes, seats, caps) == naive_seats(votes, seats, caps)


def test_targets_keep_their_limits():
    sizes, weights = [10, 1000, 300, 0], [3, 1, 2, 3]
    got = mixing.targets(sizes, weights)
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-9 and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * (i % 5 + 1) for _ in range(r.randint(0, 60))) or None, r.choice(["b", "a", "Z", None, "hot", "hot", "hot"])) for i in range(600)] + [(3, "same row", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", __import__("pyspark").sql.functions.lit("clash"))
    for shard_words in (500_000, 700):
        got = mixing.mix(docs, shard_words=shard_words).collect()
        assert len(got) == len(rows) and all(0 <= x.taken <= 2 * x.size and x.copies <= 2 for x in got)
        assert sorted(x.size for x in got) == sorted(len(t.split()) if t else 0 for _, t, _ in rows)
        names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
        sizes = [sum(len(t.split()) for _, t, s in rows if s == n and t) for n in names]
        want = dict(zip(names, mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
        for n in names:
            own = [x for x in got if x.source == n]
            assert all(abs(x.target - want[n]) < 1e-6 for x in own) and abs(sum(x.taken for x in own) - want[n]) <= 2 + 0.02 * want[n]
        again = mixing.mix(docs.repartition(7), shard_words=shard_words).collect()
        assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_language_learns_and_rejects(spark):
    words = {"aa": "the and of that with from".split(), "bb": "der die und ßchen über nicht".split(), "cc": "que ción el los ñado para".split()}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(r.randint(3, 400))), x) for i in range(240) for x in [r.choice(list(words))]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 345 !?", "bb"), (903, "THE AND OF THAT", None), (904, "über nicht " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", __import__("pyspark").sql.functions.lit("clash"))
    network = langid.train(docs, ~langid.held_out())
    got = {x.doc_id: x for x in langid.identify(docs, network).withColumn("held_out", langid.held_out()).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    kept = [(x, got[i].lang_pred) for i, _, x in rows[:240] if got[i].held_out]
    assert sum(a == b for a, b in kept) >= 0.95 * len(kept)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert langid.train(docs.limit(0), ~langid.held_out()) is None
    assert {x.lang_pred for x in langid.identify(docs, None).collect()} == {"und"}


def test_windows_answer_as_the_plain_network():
    network = langid.Network(["a", "b"], seed=3)
    data = np.random.default_rng(0).integers(1, 256, langid.WINDOW * 3).astype(np.uint8)
    data[-100:] = 0
    got = network.windows(data)
    p = network.p
    for k in range(3):
        own = data[k * langid.WINDOW : (k + 1) * langid.WINDOW]
        wide = np.concatenate([data, np.zeros(8, np.uint8)])[k * langid.WINDOW :]
        pooled = []
        for w in langid.WIDTHS:
            z = np.stack([sum(p["embed"][wide[i + j]] @ p[f"w{w}"][j] for j in range(w)) + p[f"b{w}"] for i in range(langid.WINDOW) if own[i]])
            pooled.append(z.max(0))
        want = np.tanh(np.concatenate(pooled) / 2) @ p["out"] + p["bias"]
        assert np.allclose(got[k], want, atol=1e-3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_elias_fano(values, asked):
    v = np.unique(np.array(values, np.uint64))
    e, _ = lm.EliasFano.read(lm.EliasFano.of(v).bytes(), 0)
    assert np.array_equal(e[np.arange(len(v))], v)
    x = np.array(asked + values, np.uint64)
    assert np.array_equal(e.successor(x), np.searchsorted(v, x))
    assert np.array_equal(e.find(x) >= 0, np.isin(x, v))


def plain_scores(rows, order, held):
    tok = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"] for _, t in rows]
    train = [k for k, (i, _) in enumerate(rows) if not held(i)]
    c = [Counter() for _ in range(order)]
    for k in train:
        seq = ["<s>"] * (order - 1) + tok[k]
        for j in range(order - 1, len(seq)):
            for n in range(order):
                c[n][tuple(seq[j - n : j + 1])] += 1
    total, kinds = sum(c[0].values()), len(c[0])
    context, distinct = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for n in range(1, order):
        for gram, x in c[n].items():
            context[n][gram[:-1]] += x
            distinct[n][gram[:-1]] += 1
    for k, (i, _) in enumerate(rows):
        seq, base, score = ["<s>"] * (order - 1) + tok[k], 0.0, 0.0
        for j in range(order - 1, len(seq)):
            p = (c[0][(seq[j],)] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            for n in range(1, order):
                gram = tuple(seq[j - n : j + 1])
                if x := context[n][gram[:-1]]:
                    p = max(c[n][gram] - 0.75, 0) / x + 0.75 * distinct[n][gram[:-1]] / x * p
            score += math.log10(p)
        yield i, len(tok[k]), sum(c[0][(w,)] > 0 for w in tok[k]), total, base, score


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, order):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "The", "cat", "sat", "on", "mat", f"w{r.randint(0, 40)}"]) for _ in range(r.randint(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "the cat " * 20000), (204, "the cat"), (205, "the cat"), (206, "ÀÉ É")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in lm.score(docs, langid.held_out(parts=5, part=1), order=order, chunk=2000).collect()}
    for i, n, known, total, base, score in plain_scores(rows, order, lambda i: zlib.crc32(str(i).encode()) % 5 == 1):
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total)
        assert abs(x.base_score - base) < 1e-6 * n + 1e-9 and abs(x.score - score) < 3e-4 * n
    assert lm.score(docs.limit(0), langid.held_out()).count() == 0
