"""The corpus operators against plain versions, with nulls, ties, repeats, long and empty texts."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ashlar.llm import chunks, components, decontaminate, hot, kernels, langid, linededup, minhash, paragraphs, queries, suffix, urlfilter

from . import brute

SCHEMA = "doc_id long, text string, kept string, n_lines int, component_id string"


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "and", "é", "straße", "中文", "a1", "x.", "Quick", "brown", "fox", "jumps", "over", "lazy", "dog"]
    vocabulary += ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t ", ". "]) for _ in range(k))
    base = [text(rng.randint(30, 120)) for _ in range(10)]
    docs = {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.15:
            docs[i] = rng.choice(base)
        elif kind < 0.55:
            words = rng.choice(base).split(" ")
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs[i] = " ".join(words)
        elif kind < 0.65:
            docs[i] = text(5) + rng.choice(base)[20:200] + "\n" + text(5)
        else:
            docs[i] = text(rng.randint(0, 60))
    docs[n], docs[n + 1], docs[n + 2], docs[n + 3] = None, "", " \n\t ", "two words"
    docs[n + 4], docs[n + 5] = "Two words", "long " * 3000 + "a" * 9000
    return docs


def frame(spark, docs, parts=3):
    rows = [(i, t, "clash", 7, "clash") for i, t in docs.items()]
    random.Random(9).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_words_across_blocks(monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 64)
    raw = np.frombuffer(("word " * 50 + "w" * 300 + " end").encode(), np.uint8)
    h, s, e = kernels.words(raw, kernels.SPACES)
    assert len(h) == 52 and len(set(h[:50].tolist())) == 1 and (e - s)[50] == 300


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 120)] + [(5, 5), (None, 3)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 120)) and len(out) == 61


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, k):
    out = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, docs), k=k).collect()}
    want = brute.near_duplicates(docs, k, 80)
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) and r["n_shingles"] == len(brute.shingles(docs[i], k)) for i, r in out.items())


@pytest.mark.parametrize("many, shingles", [(1024, 1 << 20), (0, 1 << 20), (0, 70)])
def test_near_duplicates_in_blocks(spark, monkeypatch, many, shingles):
    """A chain of texts, each near only to its neighbours, in blocks of two or of one long text; large buckets by rare shingles."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 2)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(minhash, "FEW", 3)
    monkeypatch.setattr(minhash, "MANY", many)
    words = [f"w{i}" for i in range(160)]
    docs = {i: " ".join(words[4 * i : 4 * i + 60]) for i in range(20)}
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, docs), k=4, share=80).collect()}
    assert out == brute.near_duplicates(docs, 4, 80)


def test_rare_shingles_join_all_similar_sets(spark, monkeypatch):
    """Every pair at the threshold shares a bucket; texts that share only a common part don't."""
    monkeypatch.setattr(hot, "LEAST", 6)
    rng = np.random.default_rng(5)
    common = set(range(1000, 1060))
    sets = [common | set(rng.integers(0, 500, int(rng.integers(5, 45))).tolist()) for _ in range(60)]
    sets += [set(s) - {min(s)} | {2000 + i} for i, s in enumerate(sets[:30])] + [common, set(common), {1}, {1}, {2, 3}]
    held = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(0, sorted(sets[0])), (0, [7, 8]), (3, [])], "doc_id long, s array<long>")
    named = spark.createDataFrame([(b, i, i, len(s)) for i, s in enumerate(sets) for b in (1, 2)], "bucket long, doc_id long, component long, n_shingles long")
    bins = {}
    for r in minhash._by_rare_shingles(named, held, 80).collect():
        bins.setdefault(r["bucket"], set()).add(r["doc_id"])
    met = {(i, j) for m in bins.values() for i in m for j in m if i < j}
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert near <= met and len(near) >= 30
    apart = [[*range(100), *range(1000 * i, 1000 * i + 30)] for i in range(1, 9)]
    held = spark.createDataFrame(list(enumerate(apart)), "doc_id long, s array<long>")
    named = spark.createDataFrame([(1, i, i, 130) for i in range(8)], "bucket long, doc_id long, component long, n_shingles long")
    assert minhash._by_rare_shingles(named, held, 80).groupBy("bucket").count().where("count > 1").count() == 0


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "same text here now"), (3, "same text here now"), (3, "same text here now"), (2, "same text here now"), (7, None)]
    out = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert out == [(-1, None, True), (2, 2, True), (3, 2, False), (3, 2, False), (7, 7, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("batches", [1, 4, 12])
def test_line_dedup(spark, docs, batches):
    df = frame(spark, docs)
    out = linededup.drop_repeated_lines(df, batches=batches)
    assert set(out.columns) == set(df.columns) | {"n_dropped"}
    want = brute.line_dedup(docs)
    for r in out.collect():
        n, dropped, kept = want[r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["text"] or "") == (n, dropped, kept) and r["kept"] == "clash"


def test_line_dedup_of_odd_rows(spark):
    rows = [(None, "a long enough line"), (2, "a long enough line"), (2, "A LONG enough line \r"), (5, "x\n a long enough line\ny"), (6, None)]
    out = sorted((r["doc_id"] or -1, r["text"], r["n_dropped"]) for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["text"] is not None)
    assert out == [(-1, "a long enough line", 0), (2, "A LONG enough line \r", 0), (2, "a long enough line", 0), (5, "x\ny", 1)]
    assert linededup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_runs_are_levelled(spark):
    index = linededup.LineIndex(spark, fanout=2)
    for b in range(4):
        index.add(spark.createDataFrame([(k, k, 10 * b + k) for k in range(b + 2)], "h1 long, h2 long, doc_id long"))
    assert [len(x) for x in index.levels] == [0, 0, 1]
    assert {r["h1"]: r["owner"] for r in index.owners().collect()} == {0: 0, 1: 1, 2: 12, 3: 23, 4: 34}


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 7])
def test_contamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    items = [(0, docs[0]), (1, "two words"), (2, "the"), (3, None), (4, "!!"), (0, docs[1]), (10, docs[2][:80]), (None, docs[3])]
    df = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, [x for x in items if x[0] is not None])
    for r in decontaminate.contamination(df, bench).collect():
        assert (r["n_words"], r["n_hit"], sorted(r["hit_items"])) == want[r["doc_id"]]
        assert r["contaminated"] == (r["n_hit"] > 0) and sum(r["hit_spans"][1::2]) - sum(r["hit_spans"][::2]) == r["n_hit"]


def test_contamination_by_items_without_an_id(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    items = [(None, docs[0]), (1, "two words"), (None, docs[3]), (10, docs[3])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: (hit, len(set(names) - {"None"})) for i, (_, hit, names) in brute.contamination(docs, items).items()}
    assert any(hit and not n for hit, n in want.values())
    out = queries.op10_decontamination(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in out} == want and all(r["contaminated"] == (r["n_hit"] > 0) for r in out)
    kept = corpus_pipeline.decontaminated(spark, frame(spark, docs), str(tmp_path)).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == {i for i, (hit, _) in want.items() if not hit}


def test_contamination_by_nothing(spark, docs):
    out = decontaminate.contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert out.where("contaminated").count() == 0 and out.count() == len(docs)


@pytest.mark.parametrize("piece", [suffix.PIECE, 200])
def test_repeated_spans(spark, docs, piece, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", piece)
    out = {r["doc_id"]: r for r in suffix.repeated_spans(frame(spark, docs)).collect()}
    want = brute.repeated_bytes(docs)
    assert out.keys() == want.keys()
    for i, (n, kept) in want.items():
        assert (out[i]["n_bytes"], bytes(out[i]["kept"])) == (n, kept)


def test_repeated_spans_of_odd_rows(spark):
    t = "x" * 30 + "y" * 40
    rows = [(1, t), (1, t), (2, "a" + t), (None, t), (3, None)]
    out = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, t), (1, t), (2, "a"), (3, "")]
    assert suffix.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_paragraphs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(80))
    docs = {i: " ".join(word() for _ in range(100)) for i in range(30)}
    for i in (4, 9, 20):
        w = docs[i].split(" ")
        docs[i] = " ".join([*w[: 3 * i], passage, *w[3 * i :]])
    docs[40] = "one line of a text that stands here twice over\n" * 2  # repeats inside one document only
    docs[41], docs[42] = None, ""
    out = paragraphs.repeated_paragraphs(frame(spark, docs)).collect()
    assert {r["doc_id"] for r in out} == {4, 9, 20}
    assert {r["kept_doc_id"] for r in out} == {4} and all(r["kept"] == (r["doc_id"] == 4) for r in out)
    for r in out:
        own = docs[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode()
        assert len(own.split()) >= 9
    assert paragraphs.repeated_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_paragraphs_with_an_edit(spark):
    rng = random.Random(5)
    w = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    edited = [*w[:200], "changed", *w[201:]]
    docs = {1: " ".join(w), 2: " ".join(edited), 3: " ".join(w)}
    out = paragraphs.repeated_paragraphs(frame(spark, docs)).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3} and {r["kept_doc_id"] for r in out} == {1}


def test_short_copies_and_passage_edges(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    some = lambda n: " ".join(word() for _ in range(n))
    docs, copies = {}, {}
    for k, n in enumerate((9, 12, 16, 20, 25, 52) * 4):
        copies[k] = some(n)
        for side in (0, 1):
            docs[2 * k + side] = f"{some(60)} {copies[k]} {some(60)}"
    short = [some(1), some(3), some(4), some(8)]
    for k, line in enumerate(short):
        docs[100 + 2 * k], docs[101 + 2 * k] = line, f"{some(30)}\n{line.upper()}\n{some(30)}"
    rows = {(r["doc_id"], docs[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode().lower(), r["kept_doc_id"]) for r in paragraphs.repeated_paragraphs(frame(spark, docs)).collect()}
    assert rows == {(2 * k + side, t, 2 * k) for k, t in copies.items() for side in (0, 1)} | {(100 + 2 * k + side, t, 100 + 2 * k) for k, t in enumerate(short) for side in (0, 1)}


def test_an_edited_paragraph_comes_whole(spark):
    rng = random.Random(15)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    docs, wanted = {}, set()
    for k in range(12):
        w = some(60)
        edited = [*w[: 15 + 2 * k], "changed", *w[16 + 2 * k :]]  # Jaccard 51 / 61
        gap = "\n" if k < 6 else " "  # a line of its own, or inside a longer one
        for doc, own in ((2 * k, w), (2 * k + 1, edited)):
            docs[doc] = gap.join(" ".join(x) for x in (some(80), own, some(80)))
            wanted.add((doc, " ".join(own)))
    out = paragraphs.repeated_paragraphs(frame(spark, docs)).collect()
    whole = {(r["doc_id"], docs[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode()): r for r in out}
    assert wanted <= set(whole)
    assert all(whole[x]["kept_doc_id"] == x[0] // 2 * 2 and whole[x]["kept"] == (x[0] % 2 == 0) for x in wanted)


def test_the_prefilter_is_as_sensitive_as_the_bands():
    rng = np.random.default_rng(16)
    lost, pairs = 0, 4000
    for _ in range(pairs):
        w = rng.integers(1, 1 << 62, 49, dtype=np.uint64)  # 45 shingles
        other = w.copy()
        other[24] ^= np.uint64(1)  # 40 of 50 are shared
        span = np.array([[0, 49]])
        lost += not (paragraphs.keys(w, span) == paragraphs.keys(other, span)).any()
    assert lost <= 0.002 * pairs  # 0.36**8 = 0.0003; 0.36**4 = 0.017


def test_language(spark):
    rng = random.Random(6)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    kinds = {"aa": ["the", "ing", "tion", "er"], "bb": ["ça", "oux", "eau", "la"], "cc": ["сло", "во", "ный", "ка"]}
    rows = [(i, make(kinds[lang], rng.randint(5, 80)), lang) for i, lang in enumerate(list(kinds) * 40)]
    df = spark.createDataFrame([*rows, (500, None, "aa"), (501, "123 !!", "aa"), (502, "", None), (503, "x" * 5000, None)], "doc_id long, text string, lang string")
    samples = langid.sample(df.where("doc_id < 60"))
    assert set(samples) == set(kinds)
    out = {r["doc_id"]: r for r in langid.identify(df.withColumn("lang_pred", F.lit(1)), samples).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows) and all(0 <= r["lang_score"] <= 1 for r in out.values())
    assert all(out[i]["lang_pred"] == "und" and out[i]["lang_score"] == 0 for i in (500, 501, 502)) and out[503]["lang_pred"] != "und"
    nothing = langid.identify(df, langid.sample(df.where("false")))
    assert nothing.where("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.where("false"), samples).count() == 0


def test_all_languages_are_learned(spark):
    rng = random.Random(17)
    lang = lambda k: "".join(chr(97 + (k * 7 + i) % 26) for i in range(2)) + chr(97 + k // 26)
    word = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(9 * k + i, " ".join(rng.choice(word[k]) for _ in range(40)), lang(k)) for k in range(70) for i in range(9 if k < 64 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.sample(df, chars=2000)
    assert len(samples) == len({x[2] for x in rows}) == 70 and sum(map(len, samples.values())) <= 2000 * 64
    assert all(r["lang_pred"] == r["lang"] for r in langid.identify(df, samples, "text").collect())


def test_longest_matches_of_the_automaton():
    text = "abracadabra"
    to = langid.suffix_automaton([ord(c) for c in text])
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            state = 0
            for c in text[i:j]:
                state = to[state][ord(c)]
    assert ord("z") not in to[0]


def test_url_rules(spark):
    rules = urlfilter.rule_table(spark, [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b", "", "block"), (None, "/", "block")])
    urls = {
        "http://Example.COM/en/x?q=/es/": ("block", "Example.com/en/".lower()), "https://www.example.com/en/": ("allow", "www.example.com/en/"), "https://x.www.example.com/en/a": ("allow", "www.example.com/en/"),
        "http://notexample.com/en/1": ("allow", "com/"), "http://example.com": ("allow", None), "http://x.net/es/1#z": ("block", "net/es/"), "http://x.net/ES/1": ("allow", None), "no scheme/es/": ("allow", None), "": ("allow", None),
        "http://q.a.b?x": ("block", "a.b"), None: ("allow", None), "http://" + "s." * 3000 + "com/" + "p/" * 3000: ("allow", "com/"), "http://u://net/es/": ("allow", None),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, *urls])], "page_id long, url string, verdict string")
    out = urlfilter.url_verdicts(pages, rules).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        assert (r["verdict"], r["rule"]) == urls[r["url"]], r
    assert urlfilter.url_verdicts(pages.where("false"), rules).count() == 0
    assert urlfilter.url_verdicts(pages, rules.where("false")).where("rule is not null").count() == 0


@pytest.mark.parametrize("t", [16, 128])
def test_sketches_together_equal_sketches_alone(t):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 5, 17, 60, 130, 600, 3000)]
    both = minhash.sketches(np.concatenate(sets), np.array([len(s) for s in sets]), t)
    assert all((minhash.sketch(s, t) == row).all() for s, row in zip(sets, both, strict=True))
    assert both.max() < np.iinfo(np.uint64).max


def test_longest_previous_factors_against_a_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(60):
        length = int(rng.integers(3, 20))
        counts, docs = rng.integers(1, 40, 4), rng.integers(0, 3, 4)
        data = np.concatenate([rng.integers(97, 99, c + length - 1).astype(np.uint8) for c in counts])
        found, at = [], 0
        for c, doc in zip(counts.tolist(), docs.tolist(), strict=True):
            found += [(doc, bytes(data[at + i : at + i + length]), at + i) for i in range(c)]
            at += c + length - 1
        order, common = suffix.suffix_order(data, np.array([x[2] for x in found]), length)
        ordered = [found[k][1] for k in order]
        alike = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
        assert ordered == sorted(ordered) and common[1:].tolist() == [alike(a, b) for a, b in zip(ordered[1:], ordered[:-1], strict=True)]
        want = [max([alike(w, v) for other, v, _ in found if other < doc], default=0) for doc, w, _ in found]
        out = suffix.previous_factors(docs, counts, data, length)
        assert out.tolist() == [x if x >= length else 0 for x in want]
        lowest = suffix.previous_smaller(np.repeat(docs, counts)[order], common, 1)
        after = suffix.previous_smaller(np.repeat(docs, counts)[order][::-1], np.concatenate(([0], common[:0:-1])), 1)[::-1]
        assert np.maximum(lowest, after)[np.argsort(order)].tolist() == want


def test_repeated_spans_of_hot_anchors(spark, docs, monkeypatch):
    from ashlar.llm import chunks

    monkeypatch.setattr(suffix, "HOT", 2)
    monkeypatch.setattr(chunks, "CHUNK", 600)
    many = docs | {1000 + i: docs[i % 20] for i in range(40)}
    out = {r["doc_id"]: r for r in suffix.repeated_spans(frame(spark, many, 6)).collect()}
    for i, (n, kept) in brute.repeated_bytes(many).items():
        assert (out[i]["n_bytes"], bytes(out[i]["kept"])) == (n, kept)


def test_passages_inside_removed_paragraphs():
    found = np.array([[5, 10, 0, 0, 7, 1], [5, 11, 0, 0, 7, 1], [0, 3, 0, 0, 9, 1], [5, 10, 0, 0, 8, 1]])
    gone = [{"doc_id": 7, "start": 2, "length": 13}, {"doc_id": 7, "start": 4, "length": 3}, {"doc_id": 9, "start": 1, "length": 50}]
    assert paragraphs.inside(found, gone).tolist() == [True, False, False, False]
    assert not paragraphs.inside(found, None).any() and len(paragraphs.inside(found[:0], gone)) == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_patterned_words_do_not_collide(spark):
    """Polynomial hashes mod 2**64 give a Thue-Morse word and its complement one value."""
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, k=4).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(1, b)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contamination(docs, items).where("contaminated").collect()] == [2]
    for size in (1, 8, 9, 64, 128, 129, 1024):  # lanes, and words beyond them
        raw = np.frombuffer(f"{a[:size]} {b[:size]} {a[:size]}".encode(), np.uint8)
        h = kernels.words(raw, kernels.SPACES)[0]
        assert h[0] == h[2] != h[1]


def test_outputs_never_clash_with_columns(spark):
    rows = [(1, "a line of some length", 5, "x"), (2, "a line of some length", 6, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id long, Gone string")
    out = {r["doc_id"]: r for r in linededup.drop_repeated_lines(df).collect()}
    assert [out[k]["gone_id"] for k in (1, 2)] == [5, 6] and [out[k]["Gone"] for k in (1, 2)] == ["x", "y"] and out[2]["text"] == ""
    pages = spark.createDataFrame([(1, "http://a.b/x", "mine")], "page_id long, url string, fits string")
    assert urlfilter.url_verdicts(pages, urlfilter.rule_table(spark, [("b", "/", "block")])).select("fits", "verdict").collect() == [("mine", "block")]


def plain_phrases(text, training):
    """Phrases of a greedy parse that are ended by what follows: the longest match, with a symbol the training text lacks if that comes next."""
    n, at = 0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in training:
            size += 1
        at += size
        if at < len(text):
            n += 1
            at += text[at] not in training
    return n


def test_phrase_counts_against_a_plain_parse():
    rng = random.Random(8)
    training = {"aa": "".join(rng.choice("abc ") for _ in range(300)), "bb": "".join(rng.choice("bcd ") for _ in range(300))}
    model = langid.Model(training)
    texts = ["".join(rng.choice("abcdz ") for _ in range(rng.randint(1, langid.SEGMENT))) for _ in range(80)]
    counts = model.phrases([langid.plain(t) for t in texts])
    for k, name in enumerate(model.names):
        assert [round(x * len(t) / model.bits[k]) for x, t in zip(counts[:, k], texts, strict=True)] == [plain_phrases(t, training[name]) for t in texts]


def test_paragraphs_against_all_pairs(spark):
    """Every pair of lines with Jaccard 0.8 at least shares a cluster, and clusters hold no other lines."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(4000)]
    base = [[rng.choice(words) for _ in range(rng.randint(6, 90))] for _ in range(25)]
    docs = {}
    for i in range(40):
        lines = []
        for _ in range(3):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line))
        docs[i] = "\n".join(lines)
    spans, at = {}, 0
    for i, t in docs.items():
        at = 0
        for line in t.split("\n"):
            spans[i, at] = brute.shingles(line, 5)
            at += len(line.encode()) + 1
    component = brute.components(sorted(spans), lambda a, b: 100 * len(spans[a] & spans[b]) >= 80 * len(spans[a] | spans[b]))
    groups = {}
    for place, c in component.items():
        groups.setdefault(c, set()).add(place)
    want = {frozenset(g) for g in groups.values() if len({d for d, _ in g}) > 1}
    got = {}
    for r in paragraphs.repeated_paragraphs(frame(spark, docs)).collect():
        if (r["doc_id"], r["start"]) in spans:
            got.setdefault(r["cluster"], set()).add((r["doc_id"], r["start"]))
    assert want <= {frozenset(g) for g in got.values()}


def test_only_repeated_runs_are_dealt():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    shared = " ".join(word() for _ in range(12))
    texts = [" ".join([*(word() for _ in range(300)), shared, *(word() for _ in range(300))]).encode() for _ in range(2)]
    row = chunks._chunk(0, [(i, 0, -1, b"", x) for i, x in enumerate(texts)]).to_pylist()[0]
    h = np.concatenate([w.grams(paragraphs.LEAST)[0] for w, _, _ in paragraphs.word_runs(row | {"again": None, "buckets": None})])
    twice = np.array(sorted(x for x in set(h.tolist()) if (h == x).sum() > 1), np.uint64)
    at = chunks.bucket_of(twice, 8)
    row["again"] = [{"bucket": int(k), "low": (twice[at == k] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), "hot": np.packbits(np.zeros((at == k).sum(), bool)).tobytes()} for k in np.unique(at)]
    row["buckets"] = 8
    every, source, own, _, _ = paragraphs._dealt(row, 8)
    assert len(every) == 8 and len(source) == 4 and every["doc"].tolist() == [0] * 4 + [1] * 4
    assert paragraphs.passages(every, source[own], 80).tolist() == [[texts[1].index(shared.encode()), len(shared), texts[0].index(shared.encode()), len(shared), 1, 0]]


def test_passages_of_near_copies_grow_with_the_copies(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(300)]
    docs = {i: " ".join(word() if k % 15 == i % 15 else w for k, w in enumerate(base)) for i in range(48)}
    told = lambda n: paragraphs.repeated_paragraphs(frame(spark, {i: docs[i] for i in range(n)})).where("not kept").count()
    few, many = told(24), told(48)
    assert 0 < few and many <= 2.5 * few  # pairs would be four times as many


def test_a_phrase_said_again_and_again_is_one_passage(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    docs, said = {}, {}
    for period in (1, 2, 3, 9, 20):
        for turn in (0, 1, 7):
            phrase = [word() for _ in range(period)]
            turned = phrase[turn % period :] + phrase[: turn % period]
            for x in (phrase * 20, turned * 20, turned * 35, turned * 12):
                said[len(docs)] = " ".join(x)
                docs[len(docs)] = " ".join([*(word() for _ in range(40)), *x, *(word() for _ in range(40))])
    rows = paragraphs.repeated_paragraphs(frame(spark, docs)).collect()
    got = sorted((r["doc_id"], r["start"], r["length"]) for r in rows if not r["kept"])
    assert got == [(i, docs[i].index(said[i]), len(said[i])) for i in docs if i % 4]
    runs = lambda words: {tuple(words[i : i + 9]) for i in range(len(words) - 8)}
    kept = [(r["doc_id"], docs[r["doc_id"]][r["start"] : r["start"] + r["length"]].split()) for r in rows if r["kept"]]
    assert {i for i, _ in kept} == {i for i in docs if i % 4 == 0} and all(runs(x) == runs(said[i].split()) for i, x in kept)


def test_near_copies_of_a_looped_text_are_counted_as_sets_with_their_counts():
    """Passages are joined only if the whole has the threshold, in texts that loop too."""
    rng = random.Random(31)
    for _ in range(400):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(12, 60))]
        phrase = [f"p{i}" for i in range(rng.randint(1, 12))]
        texts = []
        for _ in range(2):
            at = rng.randrange(len(words))
            x = words[:at] + phrase * rng.randint(2, 12) + words[at:]
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = f"e{rng.randrange(10**9)}"
            texts.append(x)
        numbers = {w: i for i, w in enumerate(sorted({w for x in texts for w in x}))}
        every = []
        for doc, x in enumerate(texts):
            start = np.cumsum([0, *(len(w) + 1 for w in x)])
            every += [(hash(tuple(numbers[w] for w in x[k : k + 9])) & (2**64 - 1), doc, k, start[k], start[k + 9] - 1 - start[k]) for k in range(len(x) - 8)]
        every = np.array(every, paragraphs.PLACE)
        source, own = paragraphs.first_places(every)
        counted = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
        held = [{tuple(x[i : i + 9]) for i in range(len(x) - 8)} for x in texts]
        covered = set()
        for start, size, kept_start, kept_size, _, _ in paragraphs.passages(every, source[own], 80).tolist():
            x, y = (" ".join(t)[a : a + n].split() for t, a, n in ((texts[1], start, size), (texts[0], kept_start, kept_size)))
            covered |= set(range(start, start + size))
            p, q = counted(x), counted(y)
            runs = [{tuple(t[i : i + 9]) for i in range(len(t) - 8)} for t in (x, y)]
            assert runs[0] == runs[1] or 100 * (p & q).total() >= 80 * (p | q).total()
        at = np.cumsum([0, *(len(w) + 1 for w in texts[1])])
        for k in range(len(texts[1]) - 8):
            if tuple(texts[1][k : k + 9]) in held[0]:
                assert set(range(at[k], at[k + 9] - 1)) <= covered


def test_blocks_give_fewer_links_than_components():
    groups = [np.arange(20), np.arange(20) + 5, np.arange(100, 120), np.arange(100, 120), np.arange(300, 310)]
    sets = [np.append(g[g != g[i % 3]], 1000 + i) for i in range(30) for g in groups]
    many = len(sets)
    pdf = pd.DataFrame({"doc_id": range(many), "component": np.arange(many) * 7, "side": 0, "s": sets})
    pairs = [(i, j) for i in range(many) for j in range(i) if 100 * len(both := set(sets[i]) & set(sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(both))]
    got = minhash._block_links(pdf, 80)
    assert len(got) < many < len(pairs)

    def classes(links):
        least = list(range(many))
        for _ in range(many):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        return least

    assert classes([(a // 7, b // 7) for a, b in got.itertuples(index=False)]) == classes(pairs)
    assert not len(minhash._block_links(pdf.iloc[:1], 80))
