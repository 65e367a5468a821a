"""Token counts, fingerprints, decontamination, line cuts and scores against brute force and on edge cases."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, line_dedup, simhash, subword_lm, tokens

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")
WORDS = ["the", "a", "Ab", "cé", "dd", "日本", "zz9", "eel"]


def random_texts(n, seed, most=30):
    r = random.Random(seed)
    return [r.choice([" ", "\n", "  ", ", "]).join(r.choice(WORDS) for _ in range(r.randint(0, most))) for _ in range(n)]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], "doc_id long, text string")


EDGES = [None, "", " ", "\n\n", "x", "▁ ▁", "<s>hi</s>\t\x00", "word " * 30_000, "y" * 50_000]


def test_token_counts_are_the_librarys(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = EDGES + random_texts(200, 1) + ["".join(random.Random(k).choices("abthe in▁ \n\té日🎉\x00<0x1>", k=25)) for k in range(300)]
    df = docs(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in tokens.count_tokens(df, MODEL).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(model.encode(t or "")), repr(t)[:60]
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 4096)


def test_token_counts_of_repeated_rows_and_of_none(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (1, "c"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens > 0) for r in tokens.count_tokens(df, MODEL).collect()))
    assert got == [(0, 0, False), (0, 3, True), (1, 1, True), (1, 3, True), (1, 3, True)]
    assert tokens.count_tokens(df.limit(0), MODEL).count() == 0


def test_merges_prefer_rank_then_left():
    rank = {"ab": 1, "bc": 0, "aa": 2}
    assert tokens.merged_count(list("abc"), rank, lambda s: 1) == 2  # a + bc
    assert tokens.merged_count(list("aaa"), rank, lambda s: 1) == 2  # the left pair
    assert tokens.merged_count(list("é"), rank, lambda s: len(s.encode())) == 2
    assert tokens.merged_count([], rank, lambda s: 1) == 0


def brute_fingerprint(text):
    import xxhash

    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    n = min(3, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark):
    for t in EDGES[:7] + random_texts(50, 2) + ["q " * 70_000]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    sparks = docs(spark, ["a b c"]).select(F.xxhash64("text").alias("h")).first().h  # Spark's own XXH64, seed 42
    assert simhash.fingerprint("A b c") == sparks % (1 << 64)


def test_anchors_meet_at_three_bits(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 64, 40, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for k in (1, 2, 3, 4, 5):
            prints.add(int(b) ^ sum(1 << int(x) for x in r.choice(64, k, replace=False)))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    got = {(x.a, x.b) for x in simhash.linked_pairs(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_components_of_chains_and_stars(spark):
    from lakeloom.llm.components import components

    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(spark):
    rows = [(5, None, 1), (3, "", 2), (3, "", 2), (9, "Some words here", 3), (2, "some WORDS here", 4), (None, "some words here", 5), (8, "other " * 40, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 2), (2, 2), (None, 2), (8, 8)], key=str)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 8, None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_and_other_texts_stay(spark):
    x, y, z = ("\n".join(f"{name} {k} of its own" for k in range(40)) for name in ("some", "others", "third"))
    rows = [(3, x), (5, x), (5, y), (5, y), (7, z), (7, None), (8, "")]
    for of in (rows, rows[::-1]):
        kept = simhash.deduplicate(spark.createDataFrame(of, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(3, x), (5, y), (7, z)]
        assert [r.doc_id for r in kept if not r.text] == [7]


def bench_words(t):
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    return "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")


def brute_contamination(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = [x for x in bench_words(t) if x]
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[n, tuple(w[s : s + n])].add(str(i))
    out = []
    for t in texts:
        w = [x for x in bench_words(t) if x]
        hit, found = set(), set()
        for n in {n for n, _ in windows}:
            for s in range(len(w) - n + 1):
                if (n, tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[n, tuple(w[s : s + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 5, 12, 13, 14, 40])))) for i in range(12)]
    items += [(20, None), (21, " .,!"), (22, "Same " * 20), (23, items[3][1]), (24, "X")]
    texts = [None, "", "...", "x", "same " * 200, "SAME, " * 14 + "end"]
    for k in range(80):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 60)))]
        for _ in range(k % 3):
            words = bench_words(r.choice(items)[1])
            a = r.randint(0, max(0, len(words) - 5))
            parts += [" ".join(words[a : a + r.randint(8, 30)]), " ".join(r.choices(vocabulary, k=r.randint(0, 20)))]
        texts.append("; ".join(parts))
    df = docs(spark, texts + texts[-3:]).withColumns({"key": F.lit(1), "w": F.lit(2), "n_hit": F.lit(3)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(0))
    got = {x.doc_id: tuple(x[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for x in decontaminate.per_row(df, decontaminate.contamination(df, bench)).collect()}
    want = brute_contamination(texts + texts[-3:], items)
    assert [got[i] for i in range(len(want))] == want
    assert sum(x[4] for x in want) > 20
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns and {x.doc_id for x in clean.collect()} == {i for i, x in enumerate(want) if not x[4]}


def test_decontamination_of_empty_tables(spark):
    df, bench = docs(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_words, r.n_hit) for r in decontaminate.per_row(df, decontaminate.contamination(df, bench)).collect()} == {(2, 0), (0, 0)}
    assert decontaminate.per_row(df.limit(0), decontaminate.contamination(df.limit(0), bench)).count() == 0
    same = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "c")], "doc_id long, text string")
    assert decontaminate.per_row(same, decontaminate.contamination(same, bench)).count() == 3


def test_decontamination_of_long_texts(spark):
    """Tens of thousands of words, without a hit, with one at the end, made of one word, and of one long word."""
    r = random.Random(14)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [(1, " ".join(r.choices(vocabulary, k=40))), (2, "same " * 13), (3, "y" * 100_000)]
    long = " ".join(r.choices(vocabulary, k=30_000))
    texts = [long, f"{long} {items[0][1]}", "same " * 20_000, "y" * 100_000, f"{items[0][1]} {long[:300]}"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts)
    got = {x.doc_id: tuple(x[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for x in decontaminate.per_row(df, decontaminate.contamination(df, bench)).collect()}
    want = brute_contamination(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    assert [x[4] for x in want] == [False, False, True, True, True]


LINE = "one two three four five six seven eight nine ten"


def test_blocks_go_from_the_later_document(spark):
    block = "\n".join(f"{LINE} {k}" for k in range(4))
    rows = [
        (1, f"start here\n{block}\nend"), (2, f"{block}\nunlike anything\nshort"), (3, f"own\n\n{block}\n\nown too"), (4, "short\nend"), (5, None), (6, ""), (None, block),
        (7, f"{LINE} 0\nbetween\n{LINE} 2"), (8, block), (8, block), (9, f"{LINE} 2 \n{LINE} 3\n{LINE.upper()} 0\n{LINE} 1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone": F.lit(1), "doc": F.lit("x"), "lines_cut": F.lit("old")})
    out = line_dedup.cut_shared_blocks(df)
    assert out.columns == ["doc_id", "text", "gone", "doc", "lines_cut", "words_cut"]
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.text, r.lines_cut))
    assert got[1] == [(rows[0][1], 0)] and got[2] == [("unlike anything\nshort", 4)] and got[3] == [("own\n\n\nown too", 4)]
    assert got[4] == [("short\nend", 0)] and got[5] == [(None, 0)] and got[6] == [("", 0)] and got[None] == [(block, 0)]
    assert got[7] == [(rows[7][1], 0)] and got[8] == [("", 4)] * 2
    assert got[9] == [(rows[10][1], 0)]  # shuffled: neither the ordered lines nor the moved ones have MIN_WORDS words
    assert line_dedup.cut_shared_blocks(df.limit(0)).count() == 0


def test_moved_blocks_go_too(spark):
    one, two = ("\n".join(f"{LINE} {name} {k}" for k in range(4)) for name in "ab")
    got = {r.doc_id: r.text for r in line_dedup.cut_shared_blocks(docs(spark, [f"{one}\n{two}", f"x\n{two}\n{one}\ny"])).collect()}
    assert got == {0: f"{one}\n{two}", 1: "x\ny"}


def held_blocks(mine, other, min_words=30):
    """Lines of mine (by number) in runs of min_words words that other has too, line by line in order."""
    out = set()
    for i in range(len(mine)):
        for j in range(len(other)):
            n = 0
            while i + n < len(mine) and j + n < len(other) and mine[i + n] == other[j + n]:
                n += 1
            if sum(len(x.split()) for x in mine[i : i + n]) >= min_words:
                out.update(range(i, i + n))
    return out


def test_blocks_of_any_earlier_document_go(spark):
    lines = [f"{LINE} {k}" for k in range(8)]
    straight = "\n".join(lines)
    again = "\n".join([lines[3], "own", *lines])  # a line's first place in its earliest holder isn't the block's
    texts = ["\n".join(reversed(lines)), straight, straight, f"x\n{straight}\ny"]
    assert {r.doc_id: r.text for r in line_dedup.cut_shared_blocks(docs(spark, texts)).collect()} == {0: texts[0], 1: straight, 2: "", 3: "x\ny"}
    assert [r.text for r in line_dedup.cut_shared_blocks(docs(spark, [again, "\n".join(lines[2:5])])).orderBy("doc_id").collect()] == [again, ""]


def test_blocks_against_every_earlier_document(spark):
    r = random.Random(11)
    pool = [" ".join([f"n{k}", *["w"] * r.choice([0, 2, 8, 11, 14, 19, 33])]) for k in range(40)]
    listing = r.sample(pool, 40)
    texts = [listing]
    for k in range(90):
        t = []
        while len(t) < r.randint(3, 25):
            of = r.choice(texts)
            a = r.randrange(len(of))
            t += r.choice([of[a : a + r.randint(1, 8)], [r.choice(pool)], [f"own {k} {len(t)}"]])
        texts.append(t)
    got = {x.doc_id: x.text for x in line_dedup.cut_shared_blocks(docs(spark, ["\n".join(f"{x}\t" if k % 2 else f" {x}" for x in t) for k, t in enumerate(texts)])).collect()}
    n = 0
    for k, t in enumerate(texts):
        want = set().union(*(held_blocks(t, e) for e in texts[:k]))
        kept = Counter(x.strip() for x in got[k].split("\n"))
        may = Counter(x for i, x in enumerate(t) if i not in want)
        assert all(kept[x] <= may[x] for x in kept if x), k
        n += len(want)
    assert n > 400


def test_lines_of_unrelated_documents_stay(spark):
    lines = [f"{LINE} {k}" for k in range(3)]
    texts = [f"own {k}\n{x}\nother {k}" for k, x in enumerate(lines)] + ["\n".join(lines)]
    assert line_dedup.cut_shared_blocks(docs(spark, texts)).where("lines_cut > 0").count() == 0


def test_cut_lines_are_one_earlier_documents(spark):
    r = random.Random(12)
    pool = [" ".join([f"n{k}", *["w"] * r.choice([2, 8, 11, 14, 19])]) for k in range(150)]
    texts = [r.sample(pool, r.randint(1, 12)) for _ in range(150)]
    got = {x.doc_id: (x.lines_cut, x.text) for x in line_dedup.cut_shared_blocks(docs(spark, ["\n".join(t) for t in texts])).collect()}
    for k, t in enumerate(texts):
        may = set()
        for e in map(set, texts[:k]):
            for run in line_dedup.neighbours([i for i, x in enumerate(t) if x in e]):
                may.update(run if sum(len(t[i].split()) for i in run) >= 30 else ())
        assert {i for i, x in enumerate(t) if x not in got[k][1].split("\n")} <= may, k


def patience_diff(a, b):
    """Pairs of equal places of two lists by the textbook recursion: equal ends, then lines that both have once, then the gaps."""
    out = []

    def go(a0, a1, b0, b1):
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        x, y = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1)}
        once = [(i, place[a[i]]) for i in range(a0, a1) if x[a[i]] == y[a[i]] == 1]
        best = []  # the longest chains by the last element, by comparing with all before
        for k, (i, j) in enumerate(once):
            before = max((best[m] for m in range(k) if once[m][1] < j), key=len, default=[])
            best.append([*before, (i, j)])
        chain = max(best, key=len, default=[])
        if chain:
            out.extend(chain)
            for (i, j), (k, m) in itertools.pairwise([(a0 - 1, b0 - 1), *chain, (a1, b1)]):
                go(i + 1, k, j + 1, m)

    go(0, len(a), 0, len(b))
    return out


def cut_by_pairs(texts, min_words=30, places=False):
    """Of each text (a list of lines), the lines that stay (or the places of those that go), by patience diff and by moved blocks against every earlier text."""
    out = []
    for k, t in enumerate(texts):
        gone, words = set(), [len(x.split()) for x in t]
        for e in texts[:k]:
            if not set(t) & set(e):
                continue
            same, block = {i for i, _ in patience_diff(t, e)}, []
            for i in [*range(len(t)), None]:
                if i in same:
                    block.append(i)
                else:
                    gone.update(block if sum(words[x] for x in block) >= min_words else ())
                    block = []
            gone |= held_blocks(t, e, min_words)
        out.append(gone if places else [x for i, x in enumerate(t) if i not in gone])
    return out


def test_cuts_equal_patience_diff_over_all_pairs(spark):
    r = random.Random(31)
    texts, fresh = [], iter(range(10**6))
    new = lambda: f"n{next(fresh)} " + "w " * r.choice([1, 4, 9, 14, 28])
    for _ in range(25):  # families: versions of a base with lines added, removed and edited
        base = [new() for _ in range(r.randint(3, 30))]
        texts.append(base)
        for _ in range(r.randint(0, 4)):
            t = [x for x in base if r.random() < 0.8]
            for _ in range(r.randint(0, 4)):
                t.insert(r.randint(0, len(t)), new())
            texts.append(t)
    texts = [[x.strip() for x in t] for t in texts if t]
    want = cut_by_pairs(texts)
    got = {x.doc_id: x.text for x in line_dedup.cut_shared_blocks(docs(spark, ["\n".join(t) for t in texts])).collect()}
    for k, t in enumerate(want):
        assert got[k].split("\n") == (t or [""]), k
    assert sum(len(a) - len(b) for a, b in zip(texts, want, strict=True)) > 300


def test_patience_alignment_of_two_documents():
    r = random.Random(32)
    for _ in range(500):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randint(0, 12))] for _ in range(2))
        matches = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y}
        got = sorted(line_dedup.patience(matches, set()))
        assert set(got) <= matches and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(got) == len(patience_diff(a, b))


def test_scattered_lines_of_many_documents_stay(spark):
    texts = [f"own {k}\n{LINE} {k}\nlast {k}" for k in range(4)] + ["\n".join(f"{LINE} {k}" for k in (2, 0, 3, 1))]
    assert line_dedup.cut_shared_blocks(docs(spark, texts)).where("lines_cut > 0").count() == 0


def test_longest_ordered_match():
    r = random.Random(5)
    for _ in range(200):
        m = sorted({(i, r.randint(0, 12)) for i in range(r.randint(0, 9))})
        m = list({a: (a, b) for a, b in m}.values())
        got = line_dedup.in_order(m)
        best = max((len(c) for k in range(len(m) + 1) for c in itertools.combinations(range(len(m)), k) if all(m[x][1] < m[y][1] for x, y in itertools.pairwise(c))), default=0)
        assert len(got) == best and all(m[x][1] < m[y][1] for x, y in itertools.pairwise(got))


def test_very_frequent_and_very_many_lines(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = docs(spark, [f"own {i}\n{passage}\nlast {i}" for i in range(500)] + ["\n".join(f"line {i}" for i in range(20_000))])
    got = line_dedup.cut_shared_blocks(df)
    assert {r.doc_id for r in got.where("lines_cut > 0").collect()} == set(range(1, 500))
    assert got.where(F.col("text").contains(passage)).count() == 1


def brute_word(word, pieces, logp, other):
    chars = "▁" + word
    if not chars:
        return 1.0

    def cut(i):
        if i == len(chars):
            return 1.0
        total = sum(math.exp(logp[pieces[chars[i:j]]]) * cut(j) for j in range(i + 1, len(chars) + 1) if chars[i:j] in pieces)
        if chars[i] not in pieces:
            total += math.exp(logp[other]) * 256.0 ** -len(chars[i].encode()) * cut(i + 1)
        return total

    return cut(0)


def test_lattice_sums_all_cuts():
    import sentencepiece

    lat = subword_lm.lattice(MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    pieces = {model.id_to_piece(i): k for k, i in enumerate(ids)}
    logp = np.log(lat.prior / lat.prior.sum())
    words = ["the", "there", "a", "naïve", "日本語", "x\x00y", "🎉", "tt", "ing", "thering,"]
    got = lat.log_probabilities([w.encode() for w in words], logp)
    for w, g in zip(words, got, strict=True):
        assert math.isclose(g, math.log(brute_word(w, pieces, logp, lat.other)), rel_tol=1e-9), w
    use = lat.expected([b"the", b"tt"], np.array([2.0, 1.0]), logp)
    shift, k = 1e-5, pieces["▁the"]
    up, down = logp.copy(), logp.copy()
    up[k] += shift
    down[k] -= shift
    slope = 2 * (lat.log_probabilities([b"the"], up) - lat.log_probabilities([b"the"], down))[0] / (2 * shift)
    assert math.isclose(use[k], slope, rel_tol=1e-4)  # a piece's expected use is the derivative


def all_cuts(chars, pieces, logp, other):
    """Every cut of chars, as (its slots, its log weight)."""
    if not chars:
        return [((), 0.0)]
    out = []
    for j in range(1, len(chars) + 1):
        if chars[:j] in pieces:
            k, w = pieces[chars[:j]], 0.0
        elif j == 1:
            k, w = other, -math.log(256) * len(chars[0].encode())
        else:
            continue
        out += [((k, *slots), logp[k] + w + x) for slots, x in all_cuts(chars[j:], pieces, logp, other)]
    return out


def test_pieces_are_found_by_their_hashes():
    lat = subword_lm.lattice(MODEL)
    keys = lat.keys[:: 7]
    hit, k = lat.places(keys)
    assert hit.all() and (lat.keys[k] == keys).all()
    ends = np.array([0, 2**64 - 1, int(lat.keys[0]) - 1, int(lat.keys[-1]) + 1], np.uint64)
    others = np.concatenate([keys + np.uint64(1), keys - np.uint64(1), ends])
    hit, _ = lat.places(others)
    assert (hit == np.isin(others, lat.keys)).all()


@pytest.mark.parametrize("rounds", [0, 2])
def test_whole_scores_by_brute_force(spark, rounds):
    lat = subword_lm.lattice(MODEL)
    texts = ["the cat", "The the dog", None, "a xé日", "cat cat nap", "", "dog, zq", "catnip the"] * 2 + ["unseen words", "thé cat"]
    training = [subword_lm.split(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in training for w in t)
    p = lat.prior / lat.prior.sum()
    for _ in range(rounds):
        use = np.full(len(p), 0.01)
        for w in c:
            cuts = all_cuts("▁" + w.decode(), lat.slot, np.log(p), lat.other)
            total = sum(math.exp(x) for _, x in cuts)
            for slots, x in cuts:
                for k in slots:
                    use[k] += math.exp(x) / total
        p = use / use.sum()
    n, ones, twos = c.total() + len(training), sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    d = min(0.9, max(0.1, ones / (ones + 2 * twos)))
    got = scored(spark, texts, rounds=rounds)
    for i, t in enumerate(texts):
        want = math.log10(len(training) / n)
        for w in subword_lm.split(t):
            lattice = sum(math.exp(x) for _, x in all_cuts("▁" + w.decode(), lat.slot, np.log(p), lat.other))
            want += math.log10(max(c[w] - d, 0) / n + d * len(c) / n * lattice)
        assert math.isclose(got[i].score, want, rel_tol=1e-9), (t, got[i].score, want)


def test_long_words_take_seconds_and_score_alike(spark):
    import time

    lat = subword_lm.lattice(MODEL)
    logp = np.log(lat.prior / lat.prior.sum())
    r = random.Random(5)
    base64 = "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=200_000)).encode()
    chinese = "".join(r.choices("日本語中文字的一是不了人我在有他这为之大来", k=200_000)).encode()
    start = time.monotonic()
    assert np.isfinite(lat.log_probabilities([base64, chinese], logp)).all()
    assert lat.expected([base64, chinese], np.ones(2), logp).sum() > 100_000
    assert time.monotonic() - start < 60
    words = [base64[k : k + n] for k, n in ((0, 40), (9, 47), (50, 48), (99, 120))] + [b"the" * 50, chinese[:300], b"x\x00" * 40]
    apart = [lat.log_probabilities([w], logp)[0] for w in words]
    near = [lat.walk("▁" + w.decode(), logp.tolist())[-1] for w in words]
    assert np.allclose(apart, near, rtol=1e-12) and np.allclose(lat.log_probabilities(words, logp), near, rtol=1e-12)
    use = lat.expected(words, np.ones(len(words)), logp)
    shift, k = 1e-5, lat.slot["th"]
    up, down = logp.copy(), logp.copy()
    up[k] += shift
    down[k] -= shift
    slope = (lat.log_probabilities(words, up) - lat.log_probabilities(words, down)).sum() / (2 * shift)
    assert math.isclose(use[k], slope, rel_tol=1e-3)


def test_ids_may_be_strings(spark):
    df = docs(spark, ["a b", "c"]).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    assert {r.doc_id for r in subword_lm.score_texts(df, MODEL).collect()} == {"d0", "d1"}


def scored(spark, texts, **more):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    df = docs(spark, texts).withColumns({"held_out": held, "word": F.lit(1), "uid": F.lit(2)})
    return {r.doc_id: r for r in subword_lm.score_texts(df, MODEL, **more).collect()}


def test_scores_count_as_stated(spark):
    texts = [None, "", "long " * 20_000, "z" * 300] + random_texts(60, 6) + ["unheardofword the"] * 8
    near, far = scored(spark, texts), scored(spark, texts, near_words=3)
    c = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*subword_lm.split(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = [*subword_lm.split(t), None]
        r = near[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.score, far[i].score, rel_tol=1e-9) and math.isclose(r.base_score, far[i].base_score, rel_tol=1e-9)
    assert scored(spark, []) == {}


def test_held_out_texts_teach_nothing(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = random_texts(40, 7)
    before = scored(spark, texts)
    for i in ids:
        texts[i] = "novelties of every kind " * 5
    after = scored(spark, texts)
    assert all(math.isclose(before[i].score, after[i].score, rel_tol=1e-12) for i in range(40) if i not in ids)
