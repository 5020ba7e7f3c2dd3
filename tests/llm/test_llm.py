"""Text operators: brute force, exact round trips, held-out accuracy, and odd inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from arborix.llm import bpe, chat, decontaminate, exact_dedup, langid, registry, simhash, suffix_dedup, token_store, toxicity, urlfilter
from arborix.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    data = [(1, None), (2, ""), (3, "a"), (4, "same text here for all"), (5, "same text here for all"), (6, " \n\t "), (7, "word " * 30_000), (8, "x" * 5000), (None, "null id"), (None, "same text here for all"), (9, "<|endoftext|> é 日本 😀"), (4, "same text here for all"), (10, "B" * 400), (10, "other text of this id")]
    df = spark.createDataFrame([(i, t) for i, t in data], "doc_id long, text string")
    for c in ("id", "v", "h", "key", "name", "fp", "word", "t", "n", "spans", "label", "lang", "ids", "_id"):
        df = df.withColumn(c, F.lit(0))
    return df


@pytest.fixture(scope="module")
def unique(odd):
    return odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


# -- 1

def test_token_store(spark, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))
    start, want = 0, {}
    for i in sorted(texts):
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.QUERIES["op1_token_store"](spark, SF).collect()}
    assert got == want


def test_word_encoder_learns_a_fragment_once():
    """Equal to the library, also with the mark between fragments in the texts, and what differs in white space only is one fragment."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from arborix.llm.fragments import pa

    path = public_tokenizers.path(token_store.VOCABULARY)
    tok, coder, learned = Tokenizer.from_file(path), token_store.WordEncoder(path), []
    learn = coder.known.learn
    coder.known.learn = lambda new: (learned.extend(new), learn(new))[1]
    for texts in (["quixotry", " quixotry\n\tquixotry  quixotry", None, "Élan Zürich's naïve ÿ", ""], ["a\0b quixotry\0", "\0", "x\0 \0y é\0日本 12\0 ok"]):
        ids, ends = coder.encode_batch(pa.array(texts, pa.string()))
        got = [ids[a:z].tolist() for a, z in zip([0, *ends], ends)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(learned) == len(set(learned))


def test_token_store_round_trip_and_damage(spark, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_store.VOCABULARY)
    tok = Tokenizer.from_file(path)
    at = str(tmp_path / "store")
    token_store.write_store(odd, at, path, shard_chunks=5)
    token_store.verify_shards(spark, at)
    coded = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    some = lambda rows: sorted(map(str, rows))
    assert some((r.id, list(r.ids)) for r in token_store.read_ids(spark, at).collect()) == some((r.doc_id, coded(r.text)) for r in odd.collect())
    # documents without an id come first, those that share one are next to each other, and no ids are left out between
    index = sorted(token_store.read_index(spark, at).collect(), key=lambda r: r.start)
    assert [r.start for r in index] == [sum(r.n_tokens for r in index[:k]) for k in range(len(index))]
    assert [r.id for r in index] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i))
    assert some((r.id, r.crc) for r in index) == some((r.doc_id, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in coded(r.text)))) for r in odd.collect())
    names = spark.read.parquet(f"{at}/chunks")
    assert names.count() == names.select("name").distinct().count()
    spoiled = names.withColumn("data", F.concat(F.expr("substring(data, 3)"), F.lit(b"\x00\x01")))
    spoiled.write.parquet(str(tmp_path / "bad/chunks"))
    for part in ("recipes", "manifest", "shards"):
        spark.read.parquet(f"{at}/{part}").write.parquet(str(tmp_path / f"bad/{part}"))
    with pytest.raises(Exception, match="does not match its name"):
        token_store.read_index(spark, str(tmp_path / "bad")).collect()
    token_store.write_store(empty, str(tmp_path / "none"), path)
    assert token_store.read_index(spark, str(tmp_path / "none")).count() == 0


def test_token_store_deals_hot_ids(spark, tmp_path):
    """Rows without an id, and rows of one id, are dealt over as many shards as rows of different ids; none has more than its bound."""
    import public_tokenizers

    path = public_tokenizers.path(token_store.VOCABULARY)
    texts = [f"word {k % 50} and {k % 7}" for k in range(600)]
    many = {}
    for kind, of in (("own", lambda k: k), ("none", lambda k: None), ("one", lambda k: 7)):
        docs = spark.createDataFrame([(of(k), t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        at = str(tmp_path / kind)
        token_store.write_store(docs, at, path, shard_chunks=50)
        token_store.verify_shards(spark, at)
        shards = spark.read.parquet(f"{at}/shards").collect()
        assert sum(r.n_docs for r in shards) == 600 and max(r.n_docs for r in shards) <= 50
        many[kind] = len(shards)
        index = sorted(token_store.read_index(spark, at).collect(), key=lambda r: r.start)
        assert [r.start for r in index] == [sum(r.n_tokens for r in index[:k]) for k in range(600)]
        assert kind != "own" or [r.id for r in index] == list(range(600))
    assert min(many.values()) >= 12 and max(many.values()) <= 2 * 12


def test_equal_stretches_share_chunks():
    import numpy as np

    draw = np.random.default_rng(4)
    shared = draw.integers(0, 40_000, 20_000).astype("<u4")
    one, two = (np.concatenate([draw.integers(0, 40_000, n).astype("<u4"), shared]) for n in (300, 777))
    chunks = []
    for ids in (one, two):
        stops = token_store.cuts(len(ids), token_store.marks(ids).tolist())
        assert stops[-1] == len(ids) and all(z - a <= token_store.MOST for a, z in zip([0, *stops], stops))
        chunks.append({ids[a:z].tobytes() for a, z in zip([0, *stops], stops)})
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0])


def test_words_are_encoded_as_whole_texts():
    import random

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_store.VOCABULARY)
    tok, own = Tokenizer.from_file(path), token_store.WordEncoder(path)
    random.seed(5)
    cases = ["".join(random.choice([*"aBc Z\n\t'sl éÉßİΣ　.,!!12日本x́😀\rªº", "<|endoftext|>", "<|ENDOFTEXT|>"]) for _ in range(random.randrange(40))) for _ in range(2000)]
    ids, ends = own.encode_batch(pa.array(cases))
    for text, a, z in zip(cases, [0, *ends], ends):
        assert ids[a:z].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_crc_combines():
    for n in (0, 1, 5, 33, 1000):
        a, b = bytes(range(50)), bytes(i % 251 for i in range(n))
        assert token_store.combine(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


# -- 2

def test_language_accuracy(spark):
    got = registry.QUERIES["op2_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 200 and set(got.held_out) == {True, False}
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_backoff_and_odd_inputs(spark, odd, empty):
    model = langid.train(spark.createDataFrame([("der die das und haus", "de"), ("the house and the door", "en")] * 3 + [(None, "en"), ("x", None)], "text string, label string"))
    assert langid.word_score(model, "the")[1] > langid.word_score(model, "the")[0]
    assert langid.word_score(model, "thes")[1] > langid.word_score(model, "thes")[0]  # unseen: n-grams of "the"
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd.where("doc_id IN (1, 2, 6)"), model).collect()}
    assert set(got.values()) == {("und", 0.0)}
    assert langid.predict(odd, model).count() == odd.count()
    assert langid.predict(empty, model).count() == 0
    none = langid.train(spark.createDataFrame([], "text string, label string"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_language_by_definition(spark):
    """Predictions against counting and scoring by hand; language names may be anything."""
    import math

    names = ["pt.br", "word", "_all", "n`x"]
    vocabulary = {c: [f"{'abcd'[k]}{w}" for w in ("la", "lala", "mi", "mimo", "xan", "日本語x")] for k, c in enumerate(names)}
    draw = __import__("random").Random(2)
    train = [(" ".join(draw.choices(vocabulary[c], k=12)), c) for c in names for _ in range(5)]
    model = langid.train(spark.createDataFrame(train, "text string, label string"))
    langs, words, marks = sorted(names), defaultdict(lambda: [0] * 4), defaultdict(lambda: [0] * 4)
    for t, c in train:
        for w in t.split():
            words[w][langs.index(c)] += 1
            for n in range(1, 6):
                for g in langid.grams(w, n):
                    marks[g][langs.index(c)] += 1
    assert model["langs"] == langs and set(model["grams"]) == set(marks)
    log = lambda kept, k: [math.log((x + 0.5) / (sum(v[i] for v in kept.values()) + 0.5 * len(kept))) for i, x in enumerate(kept[k])]
    known = {w: c for w, c in words.items() if sum(c) >= 2 and max(c) >= 2}
    for w in known:
        assert all(map(math.isclose, model["words"][w], log(known, w)))
    for g in marks:
        assert all(map(math.isclose, model["grams"][g], log({k: v for k, v in marks.items() if len(k) == len(g)}, g)))
    tests = {0: ("alala unseen", "pt.br"), 1: ("bmimo bxan", "word"), 2: ("cxanx", "_all"), 3: ("dmi", "n`x")}
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame([(i, t) for i, (t, _) in tests.items()], "doc_id long, text string"), model).collect()}
    assert got == {i: c for i, (_, c) in tests.items()}


def test_small_languages_keep_their_words(spark):
    big = " ".join(f"big{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    rows = [(big, "aa")] * 20 + [("tiny words of few", "bb")] * 2
    model = langid.train(spark.createDataFrame(rows, "text string, label string"), words=40, max_grams=60)
    assert {"tiny", "words", "of", "few"} <= set(model["words"]) and len(model["words"]) <= 40


# -- 3

def test_exact_dedup_odd_inputs(odd, empty):
    got = exact_dedup.exact_groups(odd, block_bytes=16).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in odd.collect():
        by[r.text or ""].append(r.doc_id)
    for r in got:
        text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in by[text] if i is not None]
        assert r.keep_id == max(ids, default=None) and r.group_size == len(by[text]) and r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_heavy_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_LEAST", 3)
    data = [(i, "hot " * 40 if i % 3 == 0 else f"cold {i} " * 20) for i in range(60)]
    got = exact_dedup.exact_groups(spark.createDataFrame(data, "doc_id long, text string"), block_bytes=32)
    assert {(r.doc_id, r.group_size) for r in got.collect()} == {(i, 20 if i % 3 == 0 else 1) for i in range(60)}


# -- 4

def repeats(texts, length):
    count = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] += 1
    return [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]


def removed(texts, length=400):
    out = []
    for t, starts in zip(texts, repeats(texts, length)):
        mark = bytearray(len(t))
        for s in starts:
            mark[s : s + length] = b"\1" * length
        left = bytes(b for b, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1])), hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_dedup(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op4_suffix_dedup"](spark, SF).collect()}
    ids = sorted(texts)
    assert got == dict(zip(ids, removed([texts[i].encode() for i in ids])))


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup_made_up(spark, hot):
    import random

    random.seed(2)
    base = [bytes(random.choice(b"abcdefgh ") for _ in range(random.randrange(900))) for _ in range(6)]
    made = [b"".join(random.choice(base)[random.randrange(50) :][: random.randrange(900)] + bytes(random.choice(b"xyz") for _ in range(random.randrange(4))) for _ in range(3)) for _ in range(30)]
    made += [b"a" * 1000, b"ab" * 700, b"", b"x" * 399, b"q" * 400]
    assert suffix_dedup.repeated_starts(made) == repeats(made, 400)
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.remove_repeats(df, hot=hot).collect()}
    assert got == dict(enumerate(removed(made)))


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup_odd_inputs(spark, odd, empty, hot):
    """Every row is a document, whatever its id: also ids that are null or repeat with the same or another text."""
    shared, draw = "shared passage " * 40, __import__("random").Random(1)
    own = lambda: "".join(draw.choice("abcdefgh ") for _ in range(600))
    data = [(1, shared), (1, own()), (1, own() + shared), (None, own()), (None, own() + shared), (None, "z" * 900), (2, shared), (3, "again " * 100), (3, "again " * 100)]
    more = spark.createDataFrame(data, "doc_id long, text string")
    rows = odd.select("doc_id", "text").unionByName(more).collect()
    df = odd.unionByName(more, allowMissingColumns=True)
    want = removed([(r.text or "").encode() for r in rows])
    got = suffix_dedup.remove_repeats(df, hot=hot).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in got) == sorted(str((r.doc_id, *w)) for r, w in zip(rows, want))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_frequent_runs_and_portions(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "OFTEN", 3)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 1)
    draw = __import__("random").Random(3)
    word = lambda n: bytes(draw.choice(b"abcdef ") for _ in range(n))
    base = [word(700), word(500)]
    made = [word(50) + base[k % 2] + word(30) for k in range(12)] + [base[0], base[0], base[0] + base[1]]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(made)], "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()} == dict(enumerate(removed(made)))
    text = word(20_000)
    starts = lambda portion: sorted((s, h) for _, a, z, h, _ in suffix_dedup.find_runs([b"x" * 10, text], 400, portion=portion) for s in range(a, z + 1))
    assert starts(1 << 22) == starts(3000) and len(starts(3000)) == len(text) - 399


def test_suffix_dedup_frees_its_disk(spark, monkeypatch, tmp_path):
    """Runs of k-mers that occur once go no further, and only the removed spans are still on disk when the result is read."""
    rows, keep = {}, suffix_dedup.written

    def counted(df, tag, **options):
        out = keep(df, tag, **options)
        rows[tag] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "written", counted)
    monkeypatch.setattr("arborix.functions.shared.shared_dir", lambda spark: str(tmp_path))
    draw = __import__("random").Random(4)
    word = lambda n: bytes(draw.choice(b"abcdefgh ") for _ in range(n))
    lone, passage = [word(5000) for _ in range(20)], word(600)
    made = [*lone, word(700) + passage + word(300), word(90) + passage + word(800)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(made)], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df)
    assert [p.name.split("-")[0] for p in (tmp_path / "arborix").iterdir()] == ["spans"]
    assert 2 <= rows["runkinds"] < 20
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got.collect()} == dict(enumerate(removed(made)))


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 61])
def test_stable_order(most):
    import numpy as np

    values = np.random.default_rng(5).integers(0, most, 3000)
    assert (suffix_dedup.stable_order(values) == np.argsort(values, kind="stable")).all()
    assert len(suffix_dedup.stable_order(values[:0])) == 0


# -- 5

def simhashes(texts, size):
    import xxhash

    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        s = [" ".join(w[j : j + size]) for j in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        out[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    return out


def groups(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, texts):
    fp = simhashes(texts, 3)
    want = groups(list(texts), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op5_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("radius,segments,crowd", [(1, 2, 1000), (2, 2, 1000), (2, 4, 1000), (2, 2, 3), (1, 4, 3)])
def test_links_are_those_of_all_pairs(spark, radius, segments, crowd):
    import random

    random.seed(7)
    fps = [0, 1, 3, 7, (1 << 63) - 1] + [sum(1 << random.randrange(12) for _ in range(3)) for _ in range(80)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    from arborix.operators.components import connected_components

    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(df, radius, segments, crowd)
    assert {(r.u, r.v) for r in found.collect()} == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    got = {r.node: r.component for r in connected_components(found).collect()}
    want = groups(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= radius)
    assert {f: got.get(f, f) for f in fps} == want


def test_simhash_odd_inputs(odd, empty):
    got = simhash.near_duplicates(odd, 3).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 6)} == {1}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar_groups(empty).count() == 0


def test_crowded_buckets(spark):
    """2,000 variants at 0.82 of one base and mostly 0.68 of each other: all of them are linked, through the base alone."""
    import random

    draw = random.Random(5)
    base = [f"w{i}" for i in range(204)]
    data = [(1000, " ".join(base))]
    for n in range(2000):
        words = list(base)
        for i in draw.sample(range(4, 200, 5), 4):
            words[i] = f"v{n}x{i}"
        data.append((n if n < 1000 else n + 1, " ".join(words)))
    got = simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    assert sum(r.component_id == 0 for r in got.collect()) >= 1999  # each meets the base in a bucket with a chance of 0.9999


@pytest.mark.parametrize("block", [2048, 3])
def test_members_of_buckets_are_all_compared(spark, monkeypatch, block):
    """Close pairs among texts of one template, all pairs by brute force."""
    import random

    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    draw, base = random.Random(6), [f"w{i}" for i in range(200)]
    data = []
    for n in range(120):
        words = list(base)
        for i in draw.sample(range(2, 200, 5), 7):
            words[i] = f"v{n}x{i}"
        other = list(words)
        other[199] = "end"
        data += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in data)}
    want = groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got.get(i, i) == want[i] for i in sets)


def test_near_dedup_goes_through_the_fingerprint_tables(spark, monkeypatch):
    """Without what the minwise tables give, near dedup drops what is within 2 bits and similar, and keeps the rest; with it, all that is similar goes."""
    import random

    import corpus_pipeline as C

    draw, data = random.Random(4), {}
    for n in range(12):
        own = [f"t{n}w{i}" for i in range(300)]
        other = list(own)
        for i in draw.sample(range(2, 300, 6), (0, 1, 6)[n % 3]):
            other[i] = f"t{n}x{i}"
        data |= {2 * n: " ".join(own), 2 * n + 1: " ".join([*other, "end"])}
    for i in (100, 101, 102):  # one fingerprint, that of the words that are repeated, and sets that are not similar
        data[i] = "again " * 5000 + " ".join(f"d{i}w{k}" for k in range(60))
    fp = simhashes(data, 5)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in data.items())}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2
    linked, similar = groups(list(data), lambda a, b: near(a, b) and alike(a, b)), groups(list(data), alike)
    assert fp[100] == fp[101] == fp[102] and len(data) > len(set(linked.values())) > len(set(similar.values()))
    docs = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    assert {r.doc_id for r in C.near_dedup(spark, docs, SF).collect()} == set(similar.values())
    met = simhash._met
    monkeypatch.setattr(simhash, "_met", lambda buckets, near: met(buckets, near).limit(0))
    monkeypatch.setattr(simhash, "_named", lambda buckets, close: buckets.limit(0))
    assert {r.doc_id for r in C.near_dedup(spark, docs, SF).collect()} == set(linked.values())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_of_odd_rows(spark, kind):
    """Of an id with two texts only the one that is like others goes; rows without an id are judged too, and come last; ids need not be numbers."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(reversed(words)), " ".join(words[::2] * 3)
    name = (lambda i: i) if kind == "long" else (lambda i: None if i is None else f"id{i:02}")
    rows = [(3, a), (8, a + " more"), (8, b), (9, c), (None, a + " other"), (None, c), (None, "alone " * 9), (11, None), (12, ""), (13, " \t"), (14, "x " * 100_000), (15, c), (15, c)]
    docs = spark.createDataFrame([(name(i), t, "clash", 1) for i, t in rows], f"doc_id {kind}, text string, component_id string, rep int")
    got = sorted(((r.doc_id, r.text) for r in simhash.drop_similar(docs).collect()), key=str)
    assert got == sorted([(name(i), t) for i, t in [(3, a), (8, b), (9, c), (None, "alone " * 9), (11, None), (14, "x " * 100_000)]], key=str)


def test_groups_of_one_template_are_told_apart(spark, monkeypatch):
    """Crowded buckets with many groups: each of 150 texts of one template has a close copy, and blocks are small."""
    import random

    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "TRIES", 1)
    draw, base, data = random.Random(8), [f"w{i}" for i in range(200)], []
    for n in range(150):
        own = list(base)
        for i in draw.sample(range(2, 200, 5), 6):
            own[i] = f"v{n}x{i}"
        data += [(2 * n, " ".join(own)), (2 * n + 1, " ".join([*own, "end"]))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in data)}
    want = groups(list(sets), lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]))
    assert {i: got.get(i, i) for i in sets} == want


# -- 6

def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/x", "https://a.b.Example.com/en/p?q#f", "http://example.com/en", "http://www.example.com/en/1", "x://net/es/", "http://xnet/es/", "http://spam-farm.example.org", "http://m.spam-farm.example.org/?u=://", "http://a.com?x=/", "é://café.net/fr/é"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    blocked = ["spam-farm.example.org", "cheap-pills.example.com"]
    entries = [*urlfilter.RULES, *((h, "", "listed") for h in blocked), (None, "/", "block")]
    listed = spark.createDataFrame(entries, "host string, path string, verdict string")

    def judge(url):
        host = path = ""
        if url and "://" in url:
            host, path = re.match(r"[^/?#]*", url.split("://", 1)[1])[0], re.match(r"[^/?#]*([^?#]*)", url.split("://", 1)[1])[1]
        host = lower(host)
        under = lambda h: host == h or host.endswith("." + h)
        best = max(((h + p, v) for h, p, v in urlfilter.RULES if under(h) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, None))
        return host, path, best[0], best[1] or ("block" if any(map(under, blocked)) else "allow")

    for size in (urlfilter.MAX_BYTES, 60):  # one array, and in parts
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, listed, max_bytes=size).collect()}
        assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_large_lists(spark):
    """30,000 hosts in one file and in eight against a set."""
    hosts = {f"h{i * 7919 % 90_001}.example.{'com' if i % 2 else 'org'}" for i in range(30_000)}
    listed = spark.createDataFrame([(h, "", "listed") for h in hosts], "host string, path string, verdict string")
    urls = [f"http://{'www.' if i % 3 else ''}h{i}.example.{'com' if i % 5 else 'org'}/p{i}" for i in range(0, 20_000, 3)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {i: "block" if u.split("/")[2].removeprefix("www.") in hosts else "allow" for i, u in enumerate(urls)}
    for size in (urlfilter.MAX_BYTES, 150_000):
        assert {r.page_id: r.verdict for r in urlfilter.judge(pages, listed, max_bytes=size).collect()} == want
    assert len(set(want.values())) == 2
    named = urlfilter.hosts_with_terms(spark.createDataFrame([("http://A.Spam-x.org/",), ("x://spammer.org",), (None,), ("y://ads.com?q",)], "url string"), urlfilter.BLOCKED_TERMS)
    assert {r.host for r in named.collect()} == {"a.spam-x.org", "ads.com"}


def test_colliding_digests(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s, *a: 7)
    (tmp_path / "f").write_bytes(urlfilter.array_bytes([("a.com", "/", "block"), ("b.com", "/", "allow")]))
    array = urlfilter.DigestArray(str(tmp_path / "f"))
    assert [int(i) >= 0 for i in array.find([b"a.com/", b"b.com/", b"c.com/"])] == [True, True, False]


# -- 7

def test_toxicity_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    got = registry.QUERIES["op7_toxicity"](spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    hit, wrong = (got[got.toxic == t].predicted.mean() for t in (1, 0))
    assert hit >= 0.9 and wrong <= 0.01 and got.score.between(0, 1).all()


def test_kneser_ney_is_that_of_the_definition(spark):
    """Ratios of a small corpus against counting by hand."""
    import math

    draw = __import__("random").Random(8)
    bad, fine = ["you fool", "total fool", "vile thing", "vile man"], ["good man", "a thing", "you there", "the end"]
    data = [(" ".join([*draw.choices(fine, k=4), *(draw.choices(bad, k=2) if y else [])]), y) for y in (0, 1) for _ in range(60)]
    model = toxicity.train(spark.createDataFrame(data, "text string, label int"), least=0.0)
    pair = [defaultdict(int), defaultdict(int)]
    for t, y in data:
        for p in toxicity.pairs_of(t.split()):
            pair[y][p] += 1
    either = set(pair[0]) | set(pair[1])
    D = toxicity.DISCOUNT

    def lower(y, w):
        total, k = len(pair[y]), sum(p[1] == w for p in pair[y])
        return max(k - D, 0) / total + D * len({p[1] for p in pair[y]}) / total * sum(p[1] == w for p in either) / len(either)

    def higher(y, u, w):
        n, f = sum(x for p, x in pair[y].items() if p[0] == u), sum(p[0] == u for p in pair[y])
        return (max(pair[y].get((u, w), 0) - D, 0) + D * f * lower(y, w)) / n if n else lower(y, w)

    assert set(model["pairs"]) == either and set(model["words"]) == {w for _, w in either}
    for w, (r, _) in model["words"].items():
        assert math.isclose(r, math.log(lower(1, w) / lower(0, w)), abs_tol=1e-9)
    for (u, w), (r, _) in model["pairs"].items():
        assert math.isclose(r, math.log(higher(1, u, w) / higher(0, u, w)), abs_tol=1e-9)
    model["heads"] = set(model["words"])
    assert toxicity.evidence(model, "total fool".split(), (0.0,))[0] > toxicity.evidence(model, "good man".split(), (0.0,))[0]


def test_toxicity_odd_inputs(spark, odd, empty):
    docs = spark.createDataFrame([(i, "awful idiot talk here" if i % 2 else "quiet talk about things here") for i in range(200)] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(1, 1, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 202 and all(got[i].predicted == i % 2 for i in range(200)) and got[1000].predicted == got[1001].predicted == 0
    none = labels.limit(0)
    assert {(r.score, r.predicted) for r in toxicity.toxicity(odd, none).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).count() == 102


# -- 8

def contaminated(texts, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[j : j + size])].add(str(i))
    out = {}
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[k]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 5000])
def test_decontamination(spark, texts, block):
    items = table(spark, SF, "benchmark")
    got = decontaminate.contamination(table(spark, SF, "documents"), items, block_bytes=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == contaminated(texts, [(r.item_id, r.text) for r in items.collect()])


def test_decontamination_odd_inputs(spark, unique, empty):
    items = [(1, "text here"), (2, None), (3, ""), (4, "é 日本"), (1, "a"), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(unique, bench).collect()}
    assert got == contaminated({r.doc_id: r.text for r in unique.collect()}, items)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(unique, bench.limit(0)).collect()} == {0}


# -- 9

def test_bpe_is_the_library(texts):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(bpe.VOCABULARY)
    tok, own = Tokenizer.from_file(path), bpe.ForcedBoundaryBpe(path)
    random.seed(3)
    cases = list(texts.values())[:100] + ["".join(random.choice("ab Z\n\t  's'll  é 　.,!!'12日本x́<|endoftext|>😀\r") for _ in range(random.randrange(40))) for _ in range(2000)]
    cases += ["a" * 5000, "ab" * 3000, " " * 1000, "", "!?" * 700 + " x"]
    for t in cases:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids).decode() == tok.decode(ids, skip_special_tokens=False)


def test_bpe_query_and_round_trip(spark, odd, empty):
    got = registry.QUERIES["op9_bpe"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got) and len(got) == len(texts)
    coded = bpe.encode(odd)
    assert sorted((r.text for r in bpe.decode(coded).collect())) == sorted(r.text or "" for r in odd.collect())
    assert bpe.encode(empty).count() == 0


# -- 10

def test_chat_odd_inputs(spark):
    schema = "conv_id long, turn long, role string, text string, a string, pos int"
    data = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yes"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"), (4, 0, None, None), (5, None, "user", ""), (None, 0, "user", "hi"), (6, 0, "user", "hi"), (6, 1, "bot", "no"), (2, 0, "user", "hi"), (7, 0, "a", "b"), (7, 0, "a", "c")]
    got = {r.conv_id: (r.n_turns, r.n_equal) for r in chat.render(spark.createDataFrame([(*d, "x", 9) for d in data], schema)).collect()}
    assert got == {2: (2, 2), 4: (1, 1), 5: (1, 1), 6: (2, 1), 7: (2, 1)}
    assert chat.render(spark.createDataFrame([], schema)).count() == 0


# -- rows without an id, or with the id of another text

def test_rows_are_dropped_by_id_and_text(spark):
    same = "this very text is in two rows of the table"
    docs = spark.createDataFrame([(None, same), (7, same), (None, "a clean text without an id"), (8, "first text of eight"), (8, "second text of eight"), (9, "first text of eight")], "doc_id long, text string")
    kept = exact_dedup.drop_exact_duplicates(docs).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(7, same), (None, "a clean text without an id"), (8, "second text of eight"), (9, "first text of eight")]))

    bench = spark.createDataFrame([("i", "this very text is"), (None, "second text of eight")], "item_id string, text string")
    for block in (decontaminate.BLOCK_BYTES, 1):
        kept = decontaminate.drop_contaminated(docs, bench, block_bytes=block).collect()
        assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(None, "a clean text without an id"), (8, "first text of eight"), (9, "first text of eight")]))

    known = [(i, "awful idiot talk here" if i % 2 else "quiet talk about things here") for i in range(200)]
    docs = spark.createDataFrame([*known, (None, known[1][1]), (None, known[0][1]), (300, known[1][1]), (300, known[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert sorted(str(r.doc_id) for r in toxicity.drop_toxic(docs, labels).collect() if r.doc_id is None or r.doc_id >= 200) == ["300", "None"]


def test_blocks_of_items_or_rules_do_not_change_rows(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "four five six"), (1, "one two three"), (None, "one two three"), (None, "seven eight"), (None, "seven eight")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "one two three"), ("b", "two three"), ("c", "seven eight"), (None, "five six")], "item_id string, text string")
    one, many = (sorted(map(str, decontaminate.contamination(docs, bench, block_bytes=b).collect())) for b in (decontaminate.BLOCK_BYTES, 20))
    assert one == many and len(one) == 6

    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://b.com/"), (None, "http://b.com/"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/", "block"), ("b.com", "/", "allow"), ("c.com", "", "listed")], "host string, path string, verdict string")
    one, many = (sorted(map(str, urlfilter.judge(pages, rules, max_bytes=b).collect())) for b in (urlfilter.MAX_BYTES, 20))
    assert one == many and len(one) == 5


# -- pipeline

def test_pipeline(spark):
    """Each stage against a brute-force version on what the stage before kept."""
    import corpus_pipeline as C

    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic, exact, near, clean = kept
    assert set(exact) == {max(i for i, t in toxic.items() if t == x) for x in set(toxic.values())}
    sets = {}
    for i, t in exact.items():
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    want = groups(list(exact), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert set(near) == set(want.values())
    judged = contaminated(near, [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    assert set(clean) == {i for i in near if not judged[i][4]}
    out = C.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()}
