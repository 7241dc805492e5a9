"""Token files, packing, neighbours, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.llm import ann, bitpack, minhash, packing, queries, scratch, tokens

from . import brute
from .test_text_operators import corpus, frame

pytest.importorskip("tokenizers")
BYTE, WORD = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("word_bpe_49k.json")


def library(file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_units_give_the_ids_of_whole_texts(file):
    rng = random.Random(7)
    parts = ["a", "The.\nOf", ",", " ", " ", "  ", "\n", "\t", "'s", "1", "é", "É", "́", "中", "!", "\x00", "\x1c", "\xa0", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "\r\n", "_", "ﬁ", "İ", " \n", "\u2003", "١"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    own, whole = tokens.UnitTokenizer(file), library(file)
    for t, got in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole(t), repr(t)


def test_a_file_of_another_form_is_encoded_by_the_library(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(WORD)
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("a b", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.add_tokens(["of the"])
    t.save(str(tmp_path / "other.json"))
    own, whole = tokens.UnitTokenizer(str(tmp_path / "other.json")), library(str(tmp_path / "other.json"))
    assert tokens.UnitTokenizer(WORD).by_units and tokens.UnitTokenizer(BYTE).by_units and not own.by_units
    texts = ["a b c", "end of the line", "", "<|endoftext|> a b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)] == [whole(t) for t in texts]


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_known_characters_give_the_ids_of_the_library(file):
    known = [c for c in map(chr, range(1 << 16)) if tokens._KNOWN.fullmatch(c)]
    own, whole = tokens.UnitTokenizer(file), library(file)
    texts = [x for c in known for x in (c, f"a{c}b", f"a {c} {c}{c}b", f"1{c}\n{c}1", f".{c}'s  {c}'Ll\n\n {c}")]
    rng = random.Random(9)
    texts += ["".join(rng.choice(known) for _ in range(rng.randint(1, 15))) for _ in range(5000)]
    assert len(known) > 300 and len(own.units(texts[0])) <= 1
    for t, got in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole(t), repr(t)


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_a_word_is_remembered_once_whatever_marks_follow(file):
    own = tokens.UnitTokenizer(file)
    marks = ["", ".", ",", ";", "!!", "%%%", "***", ".\nAnd", ":\n"]
    own.encode_batch([" ".join(f"x{a}{b}{m}" for a in "abcdefgh" for b in "ijklmnop" for m in marks)])
    remembered = sum(len(x) for x in vars(own).values() if isinstance(x, dict))
    assert remembered <= 80  # 64 words and some marks; 576 units of words with their marks


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "LONG_UNIT", 6)
    own, whole = tokens.UnitTokenizer(BYTE), library(BYTE)
    for t in ["a b c d e", "c d e f averyveryverylongword", "a b c averyveryverylongword", "", "a b"]:
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == whole(t)


@pytest.mark.parametrize("width", [1, 2, 7, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 333).astype(np.uint64)
    packed = bitpack.pack_bits(x, width)
    assert len(packed) == 4 * width * 11 and (bitpack.unpack_bits(packed, width, 333) == x).all()


def test_random_access(tmp_path):
    w = bitpack.Writer(str(tmp_path / "f.ids"), 17, block=64)
    ids = np.random.default_rng(0).integers(0, 1 << 17, 1000).astype(np.uint32)
    for d, (a, z) in enumerate([(0, 0), (0, 10), (10, 700), (700, 1000)]):
        w.add(d, ids[a:z])
    w.close()
    r = bitpack.Reader(str(tmp_path / "f.ids"))
    assert r.docs.tolist() == [0, 1, 2, 3] and r.first.tolist() == [0, 0, 10, 700, 1000]
    for a, z in [(0, 1), (63, 65), (5, 5), (128, 999), (0, 1000)]:
        assert (r.ids(a, z) == ids[a:z]).all()
    with pytest.raises(ValueError):
        w2 = bitpack.Writer(str(tmp_path / "g.ids"), 3, block=32)
        w2.add(0, np.full(32, 9))


def test_token_files(spark):
    docs = corpus(40)
    files = bitpack.encode_to_files(frame(spark, docs), WORD, 2, partitions=3)
    whole, at = library(WORD), 0
    got = {r["doc_id"]: r for r in bitpack.read_ids(files).collect()}
    for i in sorted(docs):
        ids = [*whole(docs[i]), 2]
        assert got[i]["start"] == at and np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        at += len(ids)
    assert len(got) == len(docs)
    assert bitpack.read_ids(bitpack.encode_to_files(frame(spark, docs).where("false"), WORD, 2)).count() == 0


@pytest.mark.parametrize("length", [2048, 5])
def test_packing(spark, length):
    docs = corpus(40)
    rows = packing.pack(frame(spark, docs), BYTE, 1, length).toPandas().sort_values(["sequence_id", "offset"])
    place = rows["sequence_id"] * length + rows["offset"]
    assert place.tolist() == [0, *np.cumsum(rows["length"])[:-1]] and (rows["offset"] + rows["length"]).max() <= length
    whole = library(BYTE)
    for i, own in rows.groupby("doc_id"):
        own = own.sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own["ids"]]).tolist()
        assert ids == [*whole(docs[i]), 1] and (own["doc_tokens"] == len(ids)).all()
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
    assert set(rows["doc_id"]) == set(docs)
    assert packing.pack(frame(spark, docs).where("false"), BYTE, 1).count() == 0


def test_packed_checksums(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op3_packing(spark, str(tmp_path)).collect()}
    assert out[2]["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())


def exact(rows, k, every):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in good.items():
        if q % every == 0:
            score = {i: float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))) for i, w in good.items() if i != q}
            out[q] = sorted(score, key=lambda i: (-score[i], i))[:k]
    return out


def test_neighbours_of_few_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)] + [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(100, 130)]
    rows += [(150, None), (200, [0.0] * 6), (250, [float("nan")] * 6), (300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, k=5, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == exact(rows, 5, 50)
    assert ann.nearest(df.where("false")).count() == 0 and ann.nearest(df.where("vec_id = 50 or vec_id = 51")).count() == 1


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, every=50).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact([(i, np.float32(v).tolist()) for i, v in rows], 5, 50)
    assert np.mean([len(got[q] & set(w)) / 5 for q, w in want.items()]) >= 0.9


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    docs = corpus(80, 3)
    docs[300], docs[301] = "12345 67890 !!", "Short and clean"
    passage = " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(14))
    docs[302] = "Before it " + passage + " after it"
    spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    kept = {i: t for i, t in docs.items() if t is not None and any(c.isalpha() for c in t)}
    kept = {i: x[2] for i, x in brute.line_dedup(kept).items()}
    group = brute.near_duplicates(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    kept = {i: t for i, t in kept.items() if not brute.contamination({i: t}, [(1, passage)])[i][1]}
    assert 302 not in kept and 301 in kept and set(got) == set(kept)
    whole = library(BYTE)
    for i, t in kept.items():
        assert np.frombuffer(b"".join(x for _, x in sorted(got[i])), "<u4").tolist() == [*whole(t), 1]


def test_pipeline_stage_without_labels(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "Clean text of words", None), (2, None, None), (3, "123 !!", None), (4, "Ещё текст", None), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "").collect()} == {1, 4}


def test_stage_names():
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_scratch_is_released(spark):
    since = scratch.mark()
    df = scratch.save(spark.range(3), "x")
    assert df.count() == 3
    scratch.release(since)
    assert minhash.BANDS * minhash.ROWS == 128


def cosines(rows, k, every):
    """Plain search: every query's k best by cosine among rows of its length."""
    out = {}
    for q, x in rows:
        if q % every:
            continue
        scale = lambda v: np.array(v) / np.abs(v).max()
        a = scale(x)
        found = []
        for i, y in rows:
            if i != q and len(y) == len(x):
                b = scale(y)
                found.append((-float(a @ b / np.sqrt((a @ a) * (b @ b))), i))
        out[q] = [i for _, i in sorted(found)[:k]]
    return out


def test_neighbours_of_tiny_huge_and_mixed_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** rng.choice([-170, 0, 170])).tolist()) for i in range(60)]
    rows += [(100 + i, rng.standard_normal(3).tolist()) for i in range(9)] + [(150, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, k=5, every=50).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {q: x for q, x in cosines(rows, 5, 50).items() if x}
    assert got == want


def test_recall_on_the_standard_table(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    asked = np.flatnonzero(ids % 50 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    want = {int(ids[a]): set(ids[np.lexsort((ids, -row))[:5]].tolist()) for a, row in zip(asked, near, strict=True)}
    got = {}
    for r in queries.op4_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)
