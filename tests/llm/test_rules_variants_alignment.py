"""The cascade, the variant join and the tokenizer sweep against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightwalk.llm import alignment, common, rules, variants

TOKENIZERS = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, word string, row int, n int, key string, kept string"  # names that operators use inside
LONG = " ".join(f"long{i}" for i in range(20_000))
ODD = [(905, LONG), (900, None), (901, ""), (902, " \n\t"), (903, "Ünï çödé x  y"), (None, "no id here at all"), (904, "same"), (904, "same")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "k", "q") for i, t in rows], DOCS).repartition(3)


# --- 11 ------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    """Words, then the four counts, straight from their definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:k] for k, line in enumerate(lines))
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def junk(rng, k):
    words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))]
    kind = k % 7
    if kind == 1:
        words = [w + "***" for w in words]
    elif kind == 2:
        words = words[:6] * 9
    elif kind == 3:
        words = [w.upper() + "X" for w in words]
    elif kind == 4:
        words = ["12", "|", "--"] * 10 + words[:3]
    text = " ".join(words)
    return text + "\nthe line\nthe line\nthe line" if kind == 5 else text + "\n- a...\n- b..." if kind == 6 else text


def test_the_counts_and_the_verdict_equal_their_definitions(spark):
    rng = random.Random(11)
    texts = [(i, junk(rng, i)) for i in range(150)] + [(500 + k, t) for k, t in enumerate(["a b c d e f a b c d e f a b", "x\nx\n\n\nx y\nx y ", "é " * 30, "a\x1cb \x85 c\xa0d"])] + ODD
    docs = documents(spark, texts)
    cascade = rules.Cascade(first=rules.BASE, always=("n_words", *rules.COUNTS)).planned(docs, sample_rows=60, share=0.9)
    assert {r.name for r in cascade.rules} == {r.name for r in rules.RULES} and cascade.costs
    got = cascade.judge(docs.withColumnRenamed("n", "n_words_before"), failed="why", n_rules="asked").collect()
    assert len(got) == len(texts)
    known = {m.name: m for m in rules.MEASURES}
    for r in got:
        assert tuple(r[c] for c in ("n_words", *rules.COUNTS)) == plain_counts(r.text), repr(r.text)[:200]
        sheet = rules.Sheet(r.text, known)
        failing = [x.name for x in (*rules.BASE, *rules.RULES) if sheet.rejected_by(x)]
        assert (r.why is None) == (not failing) and (r.why is None or r.why in failing)
        assert r.kept == "q" and r.asked <= 2 + len(rules.RULES)
    assert 20 < sum(r.why is None for r in got) < 120
    with pytest.raises(ValueError):
        cascade.judge(docs, failed="kept")


def test_windows_are_told_apart_exactly_whatever_the_vocabulary():
    rng = random.Random(12)
    for size in (2, 30, 9000):  # 9000 ** 5 does not fit into 63 bits
        words = [f"w{rng.randrange(size)}" for _ in range(12_000)]
        words += words[100:140] + [f"n{k}" for k in range(9000)]
        text = " ".join(words)
        assert rules.repeated_words(rules.numbered(text.encode().split())) == plain_counts(text)[4]


def test_rules_are_ordered_by_rejections_per_cost():
    measures = {m.name: m for m in (rules.Measure("cheap", ("text",), len), rules.Measure("dear", ("text",), len), rules.Measure("on_dear", ("dear",), abs))}
    cheap, dear, after, same = (rules.Rule(n, (m,), bool) for n, m in (("cheap", "cheap"), ("dear", "dear"), ("after", "on_dear"), ("same", "cheap")))
    rejected = np.array([[k < 10, k < 60, 60 <= k < 70, k < 10] for k in range(100)])
    names = [r.name for r in rules.ordered((cheap, dear, after, same), measures, {"cheap": 100.0, "dear": 50_000.0, "on_dear": 100.0}, rejected, set())]
    assert names == ["cheap", "same", "dear", "after"]  # what the dear measure leaves to ask is free afterwards; "same" is free at once
    assert rules.ordered((cheap, dear), measures, {"cheap": 100.0, "dear": 120.0, "on_dear": 0.0}, rejected[:, :2], set())[0].name == "dear"


def test_the_cascade_stops_at_the_first_rejection(spark):
    asked = rules.Cascade(first=rules.BASE).judge(documents(spark, [(1, "few words"), (2, "a plain line of more than ten words that nothing is wrong with")])).orderBy("doc_id").select("failed", "n_rules").collect()
    assert [tuple(r) for r in asked] == [("few_words", 1), (None, 2 + len(rules.RULES))]
    empty = documents(spark, [(1, "x")]).where("false")
    assert rules.Cascade().planned(empty).judge(empty).count() == 0


# --- 12 ------------------------------------------------------------------------------------------------------------


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, least=7, least_n=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= least_n}
    formed = {}
    for w, n in counts.items():
        found = sorted((-counts[o], o) for o in counts if abs(len(o) - len(w)) < 2 and near(w, o))
        form = found[0][1] if found and -found[0][0] >= 10 * n else None
        formed[w] = (n, len(found), form, counts[form] if form else None)
    for w, (n, many, form, form_n) in formed.items():
        root = w
        while formed[root][2]:
            root = formed[root][2]
        yield w, form, root, n, many, form_n


def test_variants_equal_all_pairs_compared(spark):
    rng = random.Random(13)
    words = ["abcdefgh", "abcdefg", "abcdefgx", "aacdefgh", "Éabcdefg", "éabcdefg", "ßbcdefgh", "bacdefgh", "zzzzzzzz", "zzzzzzz", "zzzzzzzzz", "ab×defgh", "kitchens", "kitchen"]
    words += ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 9))) for _ in range(60)] + ["Q" * 63 + "x" * k for k in range(0, 5)] + ["Q" * 40 + "y" + "Q" * 22 + "x"]
    weights = [10 ** rng.choice([0, 0.5, 1, 1.5, 2, 2.6, 3]) for _ in words]
    rows = [(i, ",".join(rng.choices(words, weights, k=120)) + "\n" + " ".join(["short", "it's"])) for i in range(60)]
    rows += [(200 + k, "".join(chr(97 + j % 26) for j in range(9000))[k:] + " " + LONG[:500]) for k in (0, 0, 1)] + [(300, "abcdefgh " * 5)] + ODD
    rows += [(400 + i, "chainaaa " * 20 + "chainaab " * (i < 30) + "chainabb " * (i < 2)) for i in range(40)]  # 800, 30 and 2, but for the misspelt
    got = [tuple(r) for r in variants.grouped(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = list(brute_variants(rows))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] and r[1] != r[2] for r in want) and any(len(r[0]) > variants.LONG and r[4] for r in want)  # chains, and long words with near ones


def test_ties_go_to_the_smallest_word_and_no_words_to_no_rows(spark):
    rows = [(None, " ".join(["bbbbbbbb"] * 50 + ["bbbbbbbc"] * 50 + ["bbbbbbb"] * 3))]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in variants.grouped(documents(spark, rows), every=1 << 40).collect()}
    assert got == {"bbbbbbb": ("bbbbbbbb", "bbbbbbbb", 2, 50), "bbbbbbbb": (None, "bbbbbbbb", 2, None), "bbbbbbbc": (None, "bbbbbbbc", 2, None)}
    assert variants.grouped(documents(spark, [(1, "few"), (2, None)])).count() == 0
    assert variants.grouped(documents(spark, [(1, "x")]).where("false")).count() == 0


def test_sums_of_deletions_meet_where_the_texts_do():
    a, b, c = "x" * 70 + "a" + "y" * 30, "x" * 70 + "b" + "y" * 30, "x" * 70 + "y" * 30
    assert set(variants._sums(a)) & set(variants._sums(b)) and variants._sums(c)[0] in set(variants._sums(c)) | set(variants._sums(a))
    assert set(variants._sums(c)) & set(variants._sums(a)) and not set(variants._sums(a)) & set(variants._sums("z" * 101))
    assert len(variants._sums("zzzz")) == 2


# --- 13 ------------------------------------------------------------------------------------------------------------

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(TOKENIZERS.path(BYTES)), sentencepiece.SentencePieceProcessor(model_file=TOKENIZERS.path(PIECES))
    a_side.encode_special_tokens = True
    byte_of = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in byte_of.values())}
    a_bytes = {k: bytes(map(byte_of.get, t)) for t, k in a_side.get_vocab().items() if all(c in byte_of for c in t)}
    b_bytes = lambda k: bytes([int(b_side.id_to_piece(k)[3:5], 16)]) if b_side.is_byte(k) else b_side.id_to_piece(k).replace("▁", " ").encode()
    found, held = [], Counter()
    for doc_id, text in rows:
        whole = f" {text}".encode()
        a = a_side.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        if not text or b"".join(map(a_bytes.get, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            found.append((doc_id, 0, 0, [], Counter()))
            continue
        ends = [np.cumsum([len(a_bytes[k]) for k in a]).tolist(), np.cumsum([len(b_bytes(k)) for k in b]).tolist()]
        cuts, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for cut in cuts:
            i2, j2 = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        held.update(links.keys())
        found.append((doc_id, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for doc_id, n_a, n_b, groups, links in found:
        told = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(n for k, n in links.items() if held[k] == most[k[0]])
        yield doc_id, n_a, n_b, len(groups), sum(links.values()), best, sum(n * held[k] for k, n in links.items()), hashlib.sha256(told.encode()).hexdigest() if told else "", told


ODD_TEXTS = ["a\rb;\r\nc", "x  y   z ", " lead", "tail ", "\n\n two", "line \n end", "a\tb\vc\fd", "<s> <|endoftext|> <unk> <0x41>", "▁a", "漢字 و ﬁ 🙂🙂", "nbsp x　y", "\0", "=" * 3000 + " " + "ab" * 2000, "it's they're DON'T", "́e", "\x85 \x1c"]


@pytest.mark.parametrize("window", [64, 1 << 15])
def test_the_sweep_equals_sets_of_ends(spark, window):
    rng = random.Random(14)
    letters = "abcXYZ éÉßñ'’ \n\t  !?,.;:-_0123²½漢字  ▁\r"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for i in range(120)]
    rows += [(1000 + i, " ".join(rng.choice(["The", "thing,", "Über", "unaligned", "x1=2", "\n"]) for _ in range(80))) for i in range(30)]
    rows += [(2000 + i, t) for i, t in enumerate(ODD_TEXTS)] + ODD
    docs = documents(spark, rows)
    aligned = alignment.align(docs, TOKENIZERS.path(BYTES), TOKENIZERS.path(PIECES), window, keep_groups=True)
    counts = common.materialize(alignment.pair_counts(aligned), "counts")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    want = sorted(map(str, brute_alignment(rows)))
    for limit in (1_000_000, 0):  # counts broadcast, and shuffled
        got = alignment.scored(aligned, counts, broadcast_rows=limit).select(*columns).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert sum(r.n_a > 0 for r in got) > 100 and any(not r.n_a for r in got)


def test_the_sweep_of_an_empty_table(spark):
    empty = documents(spark, [(1, "x")]).where("false")
    aligned = alignment.align(empty, TOKENIZERS.path(BYTES), TOKENIZERS.path(PIECES))
    assert alignment.scored(aligned, alignment.pair_counts(aligned)).count() == 0


def test_remembered_words_give_the_ids_of_whole_texts():
    a, b = alignment.ByteLevel(TOKENIZERS.path(BYTES)), alignment.Pieces(TOKENIZERS.path(PIECES), remember=40)
    assert b.cuts
    a.encode.tokenizer.encode_special_tokens = True
    rng = random.Random(15)
    letters = "abcXYZ éÉßñ'’ \n\t  !?,.;:-_0123²½漢字\x1c\x85\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ODD_TEXTS
    for text in texts:
        assert a(text).tolist() == a.encode.tokenizer.encode(" " + text, add_special_tokens=False).ids, repr(text)
        want = b.model.encode(text)
        same = b"".join(b.bytes_of[k] for k in want) == (" " + text).encode()
        got = b(text).tolist()
        assert got == want if same else len(b"".join(b.bytes_of[k] for k in got)) < len((" " + text).encode()) or not got, repr(text)
