"""The corpus operators against brute force, exact round trips and held-out accuracy, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightwalk.llm import common, decontaminate, line_dedup, packing, paragraphs, quality, simhash, token_files, tokens, toxicity, vector_search, warc

TOKENIZERS = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, key string, row int, n int, score string, content int"  # names that operators use inside


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "s", 3) for i, t in rows], DOCS).repartition(3)


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


LONG = " ".join(f"long{i}" for i in range(20_000))  # a very long text
ODD = [(905, LONG), (900, None), (901, ""), (902, " \n\t"), (903, "Ünï çödé x  y"), (None, "no id here at all"), (904, "same"), (904, "same")]


# --- 1 -------------------------------------------------------------------------------------------------------------


def test_top_k_matches_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(0, 400)]
    rows += [(400 + i, rows[3][1]) for i in range(200)]  # a frequent vector: ties
    rows += [(700, None), (701, [float("nan")] + [0.0] * 7), (702, [float("inf")] * 8), (703, [None] * 8), (750, []), (None, [1.0] * 8), (3, rows[3][1])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, shard int")
    got = defaultdict(list)
    for r in vector_search.top_k(table, F.col("vec_id") % 50 == 0, shard_rows=100, query_rows=3).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    known = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and i < 700 and v}
    want = {}
    for q in (i for i in known if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q)[:5]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_of_fewer_and_of_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.5]), (7, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_search.top_k(table, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 7, 256 * 128)]
    assert vector_search.top_k(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# --- tokens, 2, 3 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "bytes")])
def test_encoder_equals_the_library(name, kind):
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(TOKENIZERS.path(name)), tokens.Encoder(TOKENIZERS.path(name), kind, remember=50)
    rng = random.Random(2)
    letters = "abcXYZ éÉßñ'’ \n\t  !?,.;:-_0123²½ſŉıİΣσς漢字  \x1c\x85ǅ́aª·٣\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text in [*texts, "it's they're DON'T I'LL 'S", "<|endoftext|> x  <|endoftext|>", "a  b\n\n  c \n", "'ſ", "x" * 5000]:
        assert encode(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def reference_ids(name, text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(TOKENIZERS.path(name)).encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_places_every_piece_once(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([1, 20, 60, 90, 150, 400]))) for i in range(250)] + ODD
    got = packing.pack(packing.cut(documents(spark, rows), TOKENIZERS.path("word_bpe_49k.json"), 256), 256, pack_items=64, generations=5).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = reference_ids("word_bpe_49k.json", text)
        for k, at in enumerate(range(0, len(ids), 256)):
            want[doc_id, k, at, len(ids[at : at + 256]), zlib.crc32(np.array(ids[at : at + 256], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.03 * math.ceil(sum(r.length for r in got) / 256) + 1
    short = np.array([r.length for r in got if r.length < 256])
    once = packing.pack(spark.createDataFrame(got).select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32"), 256, pack_items=1 << 20)
    fit = packing.best_fit(short, np.full(len(short), -1), np.argsort(-short, kind="stable"), 256).max() + 1
    assert once.select("sequence_id").distinct().count() <= fit + sum(r.length == 256 for r in got)


def test_crossover_keeps_a_partition():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 100, 300)
    a, b = packing.seeded(lengths, 100, 2, 5)
    child = packing.mutate(lengths, packing.crossover(lengths, a, b, 100, rng), 100, rng)
    assert child.min() == 0 and len(np.unique(child)) == child.max() + 1
    assert np.bincount(child, weights=lengths).max() <= 100
    best = packing.evolve(lengths, [a, b], 100, 30, 1)[0]
    assert packing.fitness(lengths, best, 100) >= max(packing.fitness(lengths, a, 100), packing.fitness(lengths, b, 100))


def test_the_genetic_step_beats_its_seeds(spark):
    """Lengths of three tenths to a half of the capacity, where best fit in any of the seeds' orders leaves much room."""
    lengths = np.random.default_rng(0).integers(614, 1024, 1000)
    seeds = [-packing.fitness(lengths, g, 2048)[0] for island in (0, 1) for g in packing.seeded(lengths, 2048, 4, island)]
    evolved = packing.evolve(lengths, packing.seeded(lengths, 2048, 4, 0), 2048, 60, 0)[0]
    assert -packing.fitness(lengths, evolved, 2048)[0] < min(seeds)
    pieces = spark.createDataFrame([(k, 0, 0, int(x), 0) for k, x in enumerate(lengths)], packing.PIECES)
    assert packing.pack(pieces, pack_items=4096).select("sequence_id").distinct().count() < min(seeds)


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(documents(spark, [(1, "x")]).where("false"), TOKENIZERS.path("word_bpe_49k.json")).count() == 0


def test_token_files_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(200))) for i in range(120)] + ODD + [(7, "another of this id")]
    folder = common.shared_dir(spark, "test-tokens")
    files, dictionary = token_files.write(documents(spark, rows), folder, TOKENIZERS.path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in token_files.read(files, folder, dictionary).collect()), key=lambda r: r[1])
    start, want = 0, []
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])):
        ids = reference_ids("byte_bpe_50k.json", text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    store, path = token_files._files(folder)
    name = files.where("documents > 5").first().path
    with store.open_input_file(f"{path}/{name}") as source:  # one document alone
        reader = token_files.Reader(source, dictionary, "<u2")
        doc_id = int(reader.index["doc_id"][3])
        assert reader.ids(3).tolist() in [reference_ids("byte_bpe_50k.json", t) for i, t in rows if i == doc_id]
        with pytest.raises(ValueError):
            token_files.Reader(source, b"another", "<u2")
    empty, dictionary = token_files.write(documents(spark, rows).where("false"), f"{folder}-empty", TOKENIZERS.path("byte_bpe_50k.json"))
    assert token_files.read(empty, f"{folder}-empty", dictionary).count() == 0


# --- 4 -------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rng = random.Random(6)
    rows = [(i, f"http://x/{i}\r\nEvil: 1 é", f"<html>{prose(rng, 50)}</html>" if i % 3 else "<p>same ü</p>") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "u", "<p>same ü</p>"), (None, "u", "alone"), (102, "u", "again"), (102, "v", "again")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, first int").repartition(3)
    folder = common.shared_dir(spark, "test-warc")
    got = Counter(tuple(r) for r in warc.read(warc.write(pages, folder), folder).collect())
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = Counter()
    for i, _, html in rows:
        payload = (html or "").encode()
        again = first.get(html or "") is not None and i != first[html or ""]
        want[i, len(payload), warc.digest(payload), "revisit" if again else "response", first[html or ""] if again else None] += 1
    assert got == want
    folder = common.shared_dir(spark, "test-warc")
    kinds = warc.read(warc.write(pages, folder, min_payload=1000), folder).select("record_type").distinct().collect()
    assert [r[0] for r in kinds] == ["response"]
    empty = common.shared_dir(spark, "test-warc")
    assert warc.read(warc.write(pages.where("false"), empty), empty).count() == 0


# --- 5, 7 ----------------------------------------------------------------------------------------------------------


def labelled(spark, rng, n=240):
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, 80)
        bad, toxic = i % 5 == 0, i % 4 == 1
        if bad:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        if toxic:
            text += " nastyword vileword nastyword " + prose(rng, 5)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(0, None, None), (None, 1, 0), (5000, 0, 1), (1, 1, 1)]
    return documents(spark, rows + ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_by_compression(spark):
    docs, labels = labelled(spark, random.Random(7))
    model = quality.fitted(docs, labels)
    got = model.score(docs).collect()
    assert len(got) == 240 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= quality.CUT) == (r.doc_id % 5 != 0) for r in held) >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    alone = quality.fitted(docs, labels.where("quality = 1")).score(docs).select("score").distinct().collect()
    assert alone[0].score > 0.5 and quality.fitted(docs, labels).score(docs.where("false")).count() == 0


def test_nearest_examples_are_exact_and_votes_hold_out(spark):
    docs, labels = labelled(spark, random.Random(8))
    model = toxicity.ToxicityModel.fit(docs, labels, toxicity.remainder(F.col("doc_id"), 4) != 2)
    got = model.score(docs).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    # Here every word is rarer than the nasty ones; with all words in the cosine the nearest are less telling than in longer prose.
    assert sum((r.score >= toxicity.CUT) == (r.doc_id % 4 == 1 or r.doc_id == 1) for r in held) >= 0.85 * len(held)
    assert all(r.evidence == [] for r in got if r.doc_id in (900, 901, 902))
    assert model.score(docs.where("false")).count() == 0
    assert toxicity.ToxicityModel.fit(docs, labels.where("false"), F.lit(True)).score(docs).count() == 240 + len(ODD)


def test_toxicity_equals_brute_force_cosine(spark):
    """Every score and every neighbour, from words, counts and cosines of all pairs, without index or bounds."""
    docs, labels = labelled(spark, random.Random(18), 160)
    long = [(700, prose(random.Random(19), 30_000, 5000) + " vileword"), (701, "x" * 200_000)]  # very long texts, and a very long word
    docs = docs.unionByName(documents(spark, long))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.ToxicityModel.fit(docs, labels, toxicity.remainder(F.col("doc_id"), 4) != 2, ks=(3, 9))
    counts = [Counter(w for t in (text or "").lower().split() if (w := t.strip(toxicity.EDGES))) for _, text in texts]
    df = Counter(w for c in counts for w in c)
    idf = {w: (math.log((1 + len(texts)) / (1 + n)) + 1) ** 2 for w, n in df.items()}
    vector = lambda c, known=None: {w: (1 + math.log(n)) * idf[w] for w, n in c.items() if known is None or w in known}
    unit = lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    at = {i: k for k, (i, _) in enumerate(texts)}
    examples = {int(i): (int(t), unit(vector(counts[at[int(i)]]))) for i, t in zip(model.ids, model.toxic)}
    known = {w for _, v in examples.values() for w in v}
    score = {(r.doc_id, r.score): r.evidence for r in model.score(docs, evidence=9).collect()}
    assert len(examples) > 60 and len(score) >= 160
    for (doc_id, value), evidence in score.items():
        if doc_id is None:
            continue
        v = unit(vector(counts[at[doc_id]], known)) if any(w in known for w in counts[at[doc_id]]) else {}
        every = {i: sum(x * e.get(w, 0) for w, x in v.items()) for i, (_, e) in examples.items()}
        near = sorted((round(-s, 5), i) for i, s in every.items() if s > 0)
        assert np.allclose([e.similarity for e in evidence], [-s for s, _ in near[:9]], atol=2e-5)
        votes = []
        for sharp in (1, 4):
            for k in (3, 9):
                mass = sum(e.similarity**sharp for e in evidence[:k])
                votes.append(sum(e.similarity**sharp * e.toxic for e in evidence[:k]) / mass if mass else 0.0)
        assert all(e.toxic == examples[e.doc_id][0] and abs(e.similarity - every[e.doc_id]) < 1e-5 for e in evidence)
        assert abs(model.logistic(np.array([votes]))[0] - value) < 1e-9


def test_block_max_equals_all_cosines_and_leaves_blocks_closed():
    rng = np.random.default_rng(9)
    idf = rng.uniform(1, 5, 80)
    vectors = []
    for k in range(1200):  # two kinds of examples with words of their own, a few of them frequent
        terms = np.sort(np.append(rng.choice(36, rng.integers(0, 8), replace=False), rng.choice([36, 37, 38, 39], 2, replace=False)) + 40 * (k % 2))
        vectors.append((terms, toxicity.weights(rng.integers(1, 4, len(terms)), idf[terms], 2.0)))
    ends = np.cumsum([len(t) for t, _ in vectors])
    flat = [np.concatenate([v[j] for v in vectors]) for j in (0, 1)]
    index = toxicity.BlockMax(np.arange(1200), ends, flat[0].astype(np.int64), flat[1].astype(np.float32), 80, block=16)
    dense = np.zeros((1200, 80))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w.astype(np.float32)
    for _ in range(50):
        t = np.sort(rng.choice(40, 6, replace=False))
        w = toxicity.weights(np.ones(6), idf[t], 2.0)
        ((places, scores),) = index.nearest([(t, w)], 10)
        every = np.round(dense[:, t] @ w, 9)
        order = [k for k in np.lexsort((np.arange(1200), -every)) if every[k] > 0][:10]
        assert places.tolist() == order and np.allclose(scores, every[order])
    assert len(index.rows) and len(index.place) and index.opened < 50 * len(index.begin) * 0.6


# --- 6 -------------------------------------------------------------------------------------------------------------


def test_repeated_passages_of_over_50_words_are_found(spark):
    rng = random.Random(10)
    unique = itertools.count()
    fresh = lambda n: " ".join(f"u{next(unique)}" for _ in range(n))
    passage, other = fresh(51), fresh(60)
    rows = [(i, f"{fresh(rng.randrange(5, 90))} {passage}\n{fresh(30)}") for i in range(0, 12)]
    rows += [(50, fresh(40) + " " + other.upper() + " " + fresh(9)), (51, other)]
    rows += [(100 + i, fresh(120)) for i in range(20)] + [(200, fresh(10)), (201, passage[: len(passage) // 3])] + ODD
    docs = documents(spark, rows)
    found = paragraphs.repeated(docs, tile=2)
    by = defaultdict(list)
    for r in paragraphs.spans(found).collect():
        by[r.doc_id].append(r)
    assert set(by) == {*range(12), 50, 51}
    removed = {i for i, spans in by.items() if any(s.removed for s in spans)}
    assert removed == {*range(1, 12), 51}
    # A paragraph that starts a word or two early may meet others of its kind alone; the passage itself is of the first document.
    assert all(0 in {c for s in by[i] for c in s.components} for i in range(12)) and by[51][0].components == [50]
    kept = {r.doc_id: r.text for r in paragraphs.remove(docs, found).collect() if r.doc_id is not None}
    texts = dict(rows)
    assert all(kept[i] == texts[i] for i in texts if i is not None and i not in {*range(1, 12), 51})
    assert all(len(kept[i].split()) < len(texts[i].split()) - 24 for i in range(1, 12))


def test_paragraphs_of_shared_and_missing_ids_are_judged_text_by_text(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    own = [" ".join(f"o{k}x{i}" for i in range(150)) for k in range(5)]
    rows = [(1, f"{shared} {own[0]}"), (2, f"aaa bbb ccc {shared}"), (2, own[1]), (2, own[1]), (None, f"{own[2]} {shared}"), (None, own[3]), (None, None), (7, own[4])]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, cut_0 int, `__cut` string").repartition(3)
    found = paragraphs.repeated(docs)
    assert {(1, 1, True), (2, 1, False), (None, 1, False)} <= {(r.doc_id, r.component, r.first) for r in found.collect()}
    got = sorted((str(r.doc_id), " ".join((r.text or "").split()), r.cut_0, r["__cut"]) for r in paragraphs.remove(docs, found).collect())
    want = [(1, f"{shared} {own[0]}"), (2, "aaa bbb ccc"), (2, own[1]), (2, own[1]), (None, own[2]), (None, own[3]), (None, ""), (7, own[4])]
    assert got == sorted((str(i), t, 1, "c") for i, t in want)



def test_paragraphs_with_few_changes_are_one_component(spark):
    words = [f"v{i}" for i in range(25)]
    near, far = [*words[:24], "changed"], [*words[:12], "changed", *words[13:]]
    docs = documents(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    got = {r.doc_id: r.component for r in paragraphs.repeated(docs, bands=16, rows=1).collect()}
    assert got == {1: 1, 2: 1}  # Jaccard 20/22; the third shares 16 of 26
    assert paragraphs.repeated(docs.where("false")).count() == 0


def near_copies(n: int, seed: int, texts: int = 1, changes: int = 3) -> np.ndarray:
    """Surroundings of one seed: copies with some words changed, every eighth with so many that few others are alike, some cut short, some with a word put in."""
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 32, (texts, 92), dtype=np.uint32)
    base[:, 41:51] = base[0, 41:51]
    out = base[rng.integers(0, texts, n)]
    for i in range(n):
        at = rng.choice(np.r_[:41, 51:92], changes if i % 8 else 12, replace=False)
        if i % 16 == 3:
            at = np.array([rng.integers(51, 91)])
            out[i, at[0] + 1 :] = out[i, at[0] : -1].copy()
        out[i, at] = rng.integers(1, 1 << 32, len(at), dtype=np.uint32)
        if i % 16 == 5:
            out[i, : rng.integers(0, 41)] = 0
        if i % 16 == 7:
            out[i, rng.integers(51, 93) :] = 0
    return out


def test_links_of_a_large_bucket_join_what_all_pairs_join():
    for k, texts in enumerate((1, 3, 40)):
        around = near_copies(300, k, texts)
        only, known = np.random.default_rng(k).integers(0, 60, 300), np.random.default_rng(k + 9).random(300) < 0.8
        x, y = np.triu_indices(300, 1)
        apart = ~(known[x] & known[y] & (only[x] == only[y]))
        alike, _ = paragraphs.compare(around[x[apart]], around[y[apart]], 51, 0.8)
        found = [(a, b) for xs, ys, _ in paragraphs.spanning(around, known, only, 51, 0.8) for a, b in zip(xs.tolist(), ys.tolist(), strict=True)]
        pairs = set(zip(x[apart][alike].tolist(), y[apart][alike].tolist(), strict=True))
        assert set(found) <= pairs
        groups = [{i: i for i in range(300)} for _ in range(2)]
        for links, group in zip((pairs, found), groups, strict=True):
            for a, b in links:
                low, high = sorted((group[a], group[b]))
                group.update({i: low for i, g in group.items() if g == high})
        assert groups[0] == groups[1] and 1 < len(set(groups[0].values())) < 300


def test_comparing_a_bucket_grows_with_its_rows():
    took = []
    for n in (1500, 6000):
        around = near_copies(n, 5, texts=n // 300, changes=2)
        began = time.process_time()
        linked = sum(len(x) for x, _, _ in paragraphs.spanning(around, np.zeros(n, bool), np.arange(n), 51, 0.8))
        took.append(time.process_time() - began)
        assert linked > 0.7 * n
    assert took[1] < 5.5 * took[0]  # four times the rows, in four times the groups; all pairs are sixteen times as many


def test_long_passages_with_a_changed_word_go_as_a_whole(spark):
    rng = random.Random(12)
    unique = itertools.count()
    fresh = lambda n: [f"x{next(unique)}" for _ in range(n)]
    rows, ends, edits = [], {}, ("same", "changed", "put in", "left out")
    for k, n in enumerate(range(51, 101)):
        passage, edit = fresh(n), edits[k % 4]
        copy = list(passage)
        middle = n // 2
        if edit == "changed":
            copy[middle] = "other"
        elif edit == "put in":
            copy.insert(middle, "other")
        elif edit == "left out" and n > 52:
            del copy[middle]
        before, after = fresh(rng.randrange(1, 80)), fresh(rng.randrange(1, 80))
        rows += [(2 * k, " ".join([*fresh(30), *passage, *fresh(20)])), (2 * k + 1, " ".join([*before, *copy, *after]))]
        ends[2 * k + 1] = (len(before), len(before) + len(copy), " ".join([*before, *after]))
    far = fresh(60)  # over 50 words, but too many changes
    rows += [(500, " ".join([*fresh(9), *far])), (501, " ".join([*(w if j % 12 else "other" for j, w in enumerate(far)), *fresh(9)]))]
    docs = documents(spark, rows)
    found = paragraphs.repeated(docs)
    got = {(r.doc_id, r.start, r.end) for r in paragraphs.spans(found).where("removed").collect()}
    assert got == {(i, a, b) for i, (a, b, _) in ends.items()}
    texts = {r.doc_id: " ".join(r.text.split()) for r in paragraphs.remove(docs, found).collect()}
    assert all(texts[i] == rest for i, (_, _, rest) in ends.items()) and all(texts[i] == t for i, t in rows if i not in ends)


def test_copies_of_a_later_document_keep_what_only_it_has(spark):
    unique = itertools.count()
    fresh = lambda n: [f"y{next(unique)}" for _ in range(n)]
    passage, own = fresh(60), fresh(40)
    later = " ".join([*own, *passage, *fresh(40)])
    docs = documents(spark, [(1, " ".join([*fresh(50), *passage])), (5, later), (9, later)])
    found = paragraphs.repeated(docs)
    cut = {(r.doc_id, r.start, r.end) for r in paragraphs.spans(found).where("removed").collect()}
    assert cut == {(5, 40, 100), (9, 0, 140)}


# --- 8 -------------------------------------------------------------------------------------------------------------


def brute_lines(rows, threshold):
    key = lambda line: re.sub(rb"[A-Z]", lambda m: m[0].lower(), line.encode().strip(b" \t\n\v\f\r")).decode()
    split = [(i, (t or "").split("\n")) for i, t in rows]
    count = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    out = Counter()
    for i, lines in split:
        kept = [x for x in lines if count[key(x)] < threshold or not key(x)]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def lines_of(found):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect())


def line_rows(rng, n):
    common_lines = ["Shared LINE é", "\tother shared \r", "É only", "é only", ""]
    return [(i, "\n".join(rng.choice([*common_lines, f"own {rng.randrange(40)}", " "]) for _ in range(rng.randrange(1, 9)))) for i in range(n)]


def test_line_dedup_both_ways_and_reversed(spark):
    rng = random.Random(11)
    first, second = line_rows(rng, 60) + ODD, [(1000 + i, t) for i, t in line_rows(rng, 40)]
    a, b = documents(spark, first), documents(spark, second)
    alone = line_dedup.LineDedup.build(a, threshold=10, shard_keys=4)
    assert lines_of(alone.rewrite(a)) == lines_of(alone.rewrite(a, max_sent=-1)) == brute_lines(first, 10)
    both = alone.add(b)
    assert lines_of(both.rewrite(a.unionByName(b))) == brute_lines(first + second, 10)
    back = both.remove(b)
    assert Counter((bytes(r.key), r.refs) for r in back.refs.collect()) == Counter((bytes(r.key), r.refs) for r in alone.refs.collect())
    assert lines_of(back.rewrite(a)) == brute_lines(first, 10)
    assert line_dedup.LineDedup.build(a.where("false")).rewrite(a).where("n_dropped > 0").count() == 0


def test_cuckoo_filters_hold_what_they_were_given():
    rng = np.random.default_rng(12)
    keys = rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    made = line_dedup.Cuckoo.load(line_dedup.Cuckoo.of(keys).dump())
    assert made.has(keys).all()
    assert made.has(rng.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)).mean() < 0.002
    for k in keys[:2500]:
        assert made.delete(k)
    assert made.has(keys[2500:]).all() and made.has(keys[:2500]).mean() < 0.01


# --- 9 -------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def test_simhash_classes(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, 200)) for i in range(60)]
    rows += [(100 + i, rows[i % 5][1].replace("w1 ", f"w{i} ", 1)) for i in range(60)] + [(300, "two words"), (301, "TWO  WORDS"), *ODD]
    got = Counter((r.doc_id, r.fp & ((1 << 64) - 1), r.component_id) for r in simhash.classes(documents(spark, rows)).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(sorted(set(fps)), 3)
    least = defaultdict(list)
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]].append(i)
    assert got == Counter((i, f, min(least[roots[f]], default=None)) for (i, _), f in zip(rows, fps))
    assert simhash.classes(documents(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_span_all_groups(spark, radius):
    rng = random.Random(14 + radius)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:40]:
        for _ in range(8):
            values.add(v := v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, radius + 2))))
    values |= {0x5555 ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}  # a dense group
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, tile=64).collect()
    mask = (1 << 64) - 1
    pairs = {(r.a & mask, r.b & mask) for r in found}
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    want = brute_components(values, radius)
    groups = lambda f: sorted(sorted(v for v in values if f(v) == r) for r in {f(v) for v in values})
    assert groups(root) == groups(want.get)


def test_bit_sliced_counters_count():
    rng = np.random.default_rng(15)
    x = np.array([int(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False))) for _ in range(500)], np.uint64)
    value = 0b1011
    for radius in range(0, 8):
        out = np.arange(500) % 7 == 0
        near = simhash.within(simhash.planes(x), value, radius, simhash.bitset(out))
        assert near.tolist() == [k for k, v in enumerate(x) if k % 7 and (int(v) ^ value).bit_count() <= radius]


def test_blocks_are_abandoned_when_all_exceed_the_radius():
    """Random buckets, as the links meet them: rows that agree in a part of their bits and differ at random in the others."""
    rng = np.random.default_rng(16)
    fps = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) & np.uint64((1 << 38) - 1))
    seen = simhash.Compared()
    assert len(simhash.large_links(fps, 3, seen)) == 0 and seen.blocks > 600 and seen.abandoned == seen.blocks
    group = np.repeat(np.arange(len(fps) // 4), 4)
    seen = simhash.Compared()
    assert sum(len(x) for x in simhash.small_links(fps[: len(group)], group, 3, 96, seen=seen)) == 0
    assert seen.blocks > 10 and seen.abandoned >= 0.9 * seen.blocks
    close = np.unique(np.append(fps, fps[:5] ^ np.uint64(5)))  # some pairs among the others
    seen = simhash.Compared()
    assert len(simhash.large_links(close, 3, seen)) == 5 and 0.9 * seen.blocks < seen.abandoned < seen.blocks


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(200, 201), (300, 300), (None, 4)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 71)}, 200: 200, 201: 200}
    assert common.components(edges.where("false")).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------------


def brute_contamination(docs, items, width=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shape = {i: cut(t) for i, t in items}
    out = Counter()
    for doc_id, text in docs:
        words, hit, found = cut(text), set(), set()
        for i, w in shape.items():
            n = min(width, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[k : k + n]:
                        hit.update(range(at, at + n))
                        found.update([] if i is None else [str(i)])
        out[doc_id, len(words), len(hit), ",".join(sorted(found))] += 1
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(16)
    items = [(i, prose(rng, n, 50)) for i, n in enumerate([20, 13, 12, 5, 30, 2])] + [(10, "Été, à 9h!"), (11, ""), (12, None), (13, "?!"), (None, "w1 w2")]
    rows = []
    for i in range(80):
        _, item = items[i % 7]
        part = item.split()[rng.randrange(3) :]
        rows.append((i, f"{prose(rng, rng.randrange(30), 50)} {' ,'.join(part).upper()}. {prose(rng, rng.randrange(60), 50)}"))
    rows += ODD
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, share int")
    rows.append((990, " ".join([prose(rng, 20_000, 3000), items[0][1], prose(rng, 20_000, 3000)])))  # a very long text
    want = brute_contamination(rows, items)
    for most in (200_000, 9):
        found = decontaminate.find(documents(spark, rows), bench, max_windows=most).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found) == want
    texts = dict(rows)
    for r in found:
        covered = sum(len(decontaminate.words(texts[r.doc_id][s.start : s.end])) for s in r.spans)
        assert covered == r.n_hit
    none = decontaminate.find(documents(spark, rows), bench.where("false")).collect()
    assert all(r.n_hit == 0 and r["items"] == [] for r in none)
