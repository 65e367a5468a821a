"""WARC, toxicity, mixing, chat and media operators, and the pipeline, against brute force and on edge cases."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat, media, mixing, toxicity, warc


def read_back(spark, pages, tmp_path, name="w"):
    path = str(tmp_path / name)
    warc.write_warc(warc.page_records(pages), path)
    return path, warc.resolve_revisits(warc.assemble(warc.read_warc(spark, path)))


def test_pages_survive_the_archive(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n" * 60
    rows = [(1, "http://a", long), (9, "http://b", long), (4, None, long), (2, "http://c\r\nX: y", None), (3, "http://d", ""), (5, "u", "short"), (6, "u", "short"), (None, "http://n", long), (7, "http://e", "x" * 300_000 + "\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"page": F.lit(0), "digest": F.lit("no")}).repartition(3)
    path, out = read_back(spark, pages.unionByName(pages.where("page_id = 5")), tmp_path)
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(rows) and out.count() == len(rows) + 1  # the repeated row has records of its own
    for i, url, html in rows:
        body = (html or "").encode()
        r = got[i]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        revisit = html == long and i != 9
        assert (r.record_type, r.refers_to_page) == (("revisit", 9) if revisit else ("response", None))
        if not revisit:
            assert bytes(r.response.payload) == body
        assert r.request.record_type == "request" and [m.fields["page_id"] for m in r.metadata] == [str(i) if i is not None else ""]
        assert r.target_uri == (url and url.replace("\r", "%0A").replace("\n", "%0A"))
    _, none = read_back(spark, pages.limit(0), tmp_path, "none")
    assert none.count() == 0


def test_every_row_is_a_capture(spark, tmp_path):
    """Held against the registered SQL: repeated rows, ids with other urls, several null ids, ties for the largest id."""
    import duckdb

    from lakeloom.llm import queries

    long, other = "a" * 1500, "é" * 700
    rows = [(1, "a", "s"), (1, "b", "s"), (None, "c", "s"), (None, "d", "s"), (5, "u", "s"), (5, "u", "s"), (7, "p", long), (7, "p", long), (7, "q", long), (3, "p", long), (None, "p", long), (None, None, long)]
    rows += [(None, "x", other), (None, "x", other), (8, "y", "b" * 999), (9, "y", "b" * 999), (4, "z", "c" * 1000), (6, "z", "c" * 1000), (2, "w", None), (2, "w", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op1_warc_transactions(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op1_warc_transactions"])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, ((*r,) for r in got.select(columns).collect()))) == sorted(map(repr, want.fetchall())) and got.count() == len(rows)


def record(kind, rid, block=b"", *headers):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, *headers, *([b"WARC-Record-ID: " + rid] if rid else []), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 404 Gone\r\nA: b\r\n\r\nbody"
    app = b"Content-Type: application/http"
    a = [record(b"warcinfo", b"<i>", b"x: y"), record(b"response", b"<r1>", http, app), record(b"request", b"<q1>", b"GET /\r\n\r\n", app, b"WARC-Concurrent-To: <r1>")]
    b = [
        record(b"metadata", b"<m1>", b"k: v\r\n", b"Content-Type: application/warc-fields", b"WARC-Concurrent-To: <q1>"),  # by its request
        b"garbage that starts no record\r\n\r\n", record(b"response", b"<r2>", http, app, b"WARC-Concurrent-To: <q2>"),  # named the other way round
        record(b"request", b"<q2>", b"GET /2\r\n\r\n", app), record(b"metadata", b"<alone>", b"z"), record(b"response", b"<r1>", b"again", app), record(b"resource", None, b"raw"),
        record(b"response", b"<cut>", b"0123456789")[:-9],
    ]
    for name, parts in (("a.warc.gz", a), ("b.warc.gz", b)):
        (tmp_path / name).write_bytes(b"".join(gzip.compress(p) for p in parts))  # a member for each record
    records = warc.read_warc(spark, str(tmp_path / "*.gz"))
    assert {r.record_id: r.truncated for r in records.collect()}["<cut>"]
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert len(got) == 5 and got["<alone>"].response is None and got["<alone>"].metadata[0].record_id == "<alone>"
    assert got["<r1>"].request.record_id == "<q1>" and [m.record_id for m in got["<r1>"].metadata] == ["<m1>"] and got["<r1>"].response.http_status == 404
    assert bytes(got["<r1>"].response.payload) == b"body" and got["<r2>"].request.record_id == "<q2>" and got["<r2>"].metadata is None
    assert [r.record_type for k, r in got.items() if k.endswith("#7")] == ["resource"] or any(r.record_type == "resource" for r in got.values())
    (tmp_path / "c.warc").write_bytes(b"".join(a))
    with pytest.raises(Exception, match="only gzip"):
        warc.read_warc(spark, str(tmp_path / "c.warc")).collect()


def test_toxic_documents_are_found(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        toxic, junk = i % 5 == 0, i % 10 == 0
        w = r.choices(words, k=r.randint(15, 200))
        for _ in range(2 + len(w) // 20 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["vile", "foul"]) if junk else "rotten")
        texts.append((i, " ".join(w), toxic))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if junk else 1, int(toxic)))
    df = spark.createDataFrame([t[:2] for t in texts] + [(1000, None), (1001, ""), (1002, "q " * 100_000), (None, "rotten rotten")], "doc_id long, text string").withColumn("y0", F.lit(1))
    lab = spark.createDataFrame(labels + labels[:50] + [(5000, 1, 1), (None, 1, 1), (3, None, 1)], "doc_id long, quality long, toxic long")
    models = toxicity.train_chain(df, lab)
    assert [len(m["chain"]) for m in models] == [0, 1, 2]
    got = {x.doc_id: x.p_toxic for x in toxicity.score(df, models).collect()}
    held = [t for t in texts if not any(t[0] == x[0] for x in labels)]
    assert len(held) > 150 and np.mean([(got[i] >= 0.5) == toxic for i, _, toxic in held]) > 0.97
    assert got[None] > 0.5 and all(got[i] < 0.5 for i in (1000, 1001, 1002))
    assert toxicity.train_chain(df, lab.limit(0)) == []
    assert {x.p_toxic for x in toxicity.score(df.limit(3), []).collect()} == {None}
    assert toxicity.score(df.limit(0), models).count() == 0


def test_out_of_fold_odds_are_blind():
    """A feature that only marks the held-out rows can't help them."""
    import pandas as pd

    n = 60
    y = [i % 2 for i in range(n)]
    one = lambda *s: np.array(s, np.int32).tobytes()
    pdf = pd.DataFrame({"doc_id": range(n), "held": 0, "fold": [i % 3 for i in range(n)], "y": y, "probs": [[]] * n, "slots": [[y[i] + 2 * (i % 3)] for i in range(n)], "vals": [[1.0]] * n})
    p = np.array(toxicity._train_fold(pdf)["seen"][0])
    assert np.abs(p - 0.5).max() < 0.1


def brute_chain(texts, flags, folds, most):
    """The chain refitted on dense matrices, without Spark: {doc_id: text}, {doc_id: (flag a category)}, {doc_id: fold}."""
    ids = sorted(flags)

    def features(text):
        words = re.findall(r"\w+", (text or "").lower())
        n = Counter(x for w in words for x in [w] + ([f"^{w[:5]}"] if len(w) > 5 else []))
        out = defaultdict(int)
        for x, k in n.items():
            out[zlib.crc32(x.encode()) % 2**18] += k
        return {s: math.log(1 + k) for s, k in out.items()}

    x = {i: features(t) for i, t in texts.items()}
    chain_in = {i: [] for i in ids}
    models, sigmoid = [], lambda z: 1 / (1 + np.exp(-np.clip(z, -12, 12)))
    for k in range(len(flags[ids[0]])):
        oof = {}
        for held in [0, 1, 2, -1]:
            train = [i for i in ids if folds[i] != held]
            share = sum(flags[i][k] for i in train) / len(train)
            n, pos = Counter(s for i in train for s in x[i]), Counter(s for i in train for s in x[i] if flags[i][k])
            score = {s: abs(pos[s] - n[s] * share) / math.sqrt(n[s] + 1) for s in n if n[s] >= 2}
            best = sorted([s for s in score if score[s] > 0], key=lambda s: (-score[s], s))[:most]
            matrix = lambda some: np.array([[x[i].get(s, 0.0) for s in best] + chain_in[i] + [1.0] for i in some])  # noqa: E731, B023
            a, y = matrix(train), np.array([float(flags[i][k]) for i in train])
            w, m, v = np.zeros(a.shape[1]), 0, 0
            w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
            for t in range(1, 251 if 0 < y.sum() < len(y) else 1):
                g = a.T @ (1 / (1 + np.exp(-a @ w)) - y) / len(y) + 1e-4 * np.append(w[:-1], 0)
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
                w = w - 0.15 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            if held >= 0 and len(train) < len(ids):
                rest = [i for i in ids if folds[i] == held]
                oof |= dict(zip(rest, sigmoid(matrix(rest) @ w), strict=True))
        models.append((dict(zip(best, w, strict=False)), w[len(best) : -1], w[-1]))
        chain_in = {i: [*chain_in[i], oof[i]] for i in ids}
    out = {}
    for i in texts:
        p = []
        for words, chain, bias in models:
            p.append(float(sigmoid(sum(words.get(s, 0) * v for s, v in x[i].items()) + sum(c * q for c, q in zip(chain, p, strict=True)) + bias)))
        out[i] = p
    return out


def test_chain_against_a_refit(spark):
    r = random.Random(21)
    texts, labels = {}, []
    for i in range(150):
        w = r.choices([f"word{k}" for k in range(60)], k=r.randint(1, 40)) + ["vile"] * (i % 3 == 0) + ["rotten"] * (i % 4 == 0)
        texts[i] = " ".join(r.sample(w, len(w)))
        if i % 5:
            labels.append((i, int(i % 4 == 0), int(i % 3 == 0 or i % 4 == 0)))
    texts |= {500: None, 501: ""}
    absent = [(10_000 + k, k % 2, 1) for k in range(4000)]  # labels of documents that aren't there take no places
    other = [(i, "zzz " + texts[i]) for i in range(40)]  # a second text of some ids
    lab = spark.createDataFrame(labels + absent, "doc_id long, quality long, toxic long")
    df = spark.createDataFrame([*texts.items(), *other], "doc_id long, text string")
    h = {r.doc_id: r for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)).alias("fold"), F.xxhash64("doc_id").alias("at")).distinct().collect()}
    text_hash = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    of = {**texts, **{i: min((t, texts[i]), key=lambda t: text_hash[i, t]) for i, t in other}}
    used = sorted((x for x in labels), key=lambda x: h[x[0]].at)[:100]
    flags = {i: (int(t and not q), int(t and q), t) for i, q, t in used}
    want = brute_chain(of, flags, {i: h[i].fold for i in of}, 25)
    for frame in (df, df.orderBy(F.desc("text")).repartition(5)):
        models = toxicity.train_chain(frame, lab, max_train=100, features=25)
        got = {(x.doc_id, x.text): (x.p_toxic_junk, x.p_toxic_prose, x.p_toxic) for x in toxicity.score(df, models).collect()}
        for i, t in of.items():
            assert np.allclose(got[i, t], want[i], atol=1e-6), (i, got[i, t], want[i])
    assert len({round(p[2], 3) for p in want.values()}) > 20


def test_ids_of_any_type_are_scored(spark):
    df = spark.createDataFrame([(f"d{k}", "bad " * (k % 2) + "word good") for k in range(40)], "doc_id string, text string")
    models = toxicity.train_chain(df, df.select("doc_id", F.lit(0).alias("quality"), (F.col("text").startswith("bad")).cast("int").alias("toxic")))
    assert {x.text.startswith("bad"): x.p_toxic > 0.5 for x in toxicity.score(df, models).collect()} == {True: True, False: False}


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_the_targets(spark, seed):
    r = random.Random(seed)
    rows = []
    for s, n, most in ((None, 30, 40), ("b", 900, 20), ("É", 60, 300), ("a", 5, 2), ("z", 200, 60), ("c", 3, 0), ("B", 2500, 9)):
        rows += [(len(rows) + k, " \t".join(["w"] * r.randint(0, most)) or r.choice([None, "", "  "]), s) for k in range(n)]
    rows += [(None, "x y z", "b")] * 7 + [(3, "one two", "b")] * 5 + [(99_999, "long " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(0), "n": F.lit(0), "rate": F.lit("x")})
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and Counter(x.doc_id for x in got) == Counter(x[0] for x in rows)
    sizes, taken, target, biggest = Counter(), Counter(), {}, defaultdict(int)
    for x in got:
        assert 0 <= x.taken == x.copies * x.size <= 2 * x.size
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        biggest[x.source] = max(biggest[x.source], x.size)
    want = brute_targets(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9), s
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], biggest[s]), s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_one_text_in_two_sources_is_taken_from_both(spark):
    rows = [(1, "a b c", "a"), (1, "a b c", "b"), (1, "a b c", "b"), (2, "d e", "a"), (3, None, None), (4, "f " * 9, None)] + [(10 + k, "w " * (k % 7), "ab"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want = mixing.mixed_documents(df).collect(), Counter()
    for x in mixing.mix(df).collect():
        want[x.source] += x.taken
    taken = Counter()
    for x in got:
        taken[x.source] += x.taken
    assert taken == want and len({(x.doc_id, x.source) for x in got}) == len(got)


def test_an_unsolved_dual_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 6)
    monkeypatch.setattr(mixing, "TOLERANCE", -1.0)
    hist = spark.createDataFrame([("a", 1, 10), ("a", 9, 5)], "source string, size long, docs long")
    with pytest.raises(RuntimeError, match="isn't solved"):
        mixing.solve(hist, spark.createDataFrame([("a", 55, 15, 60.0)], "source string, source_size long, docs long, target double"))


def test_newton_finds_the_dual(spark):
    hist = spark.createDataFrame([("a", k, 10 - k) for k in range(1, 9)] + [(None, 5, 4), (None, 1, 9)], "source string, size long, docs long")
    totals = {"a": sum(k * (10 - k) for k in range(1, 9)), None: 29}
    want = {"a": 1.7 * totals["a"], None: 0.2 * totals[None]}
    targets = spark.createDataFrame([(s, totals[s], {"a": 44, None: 13}[s], want[s]) for s in totals], "source string, source_size long, docs long, target double")
    lam = {r.source: r.lam for r in mixing.solve(hist, targets).collect()}
    for s in totals:
        mean = totals[s] / {"a": 44, None: 13}[s]
        rows = [(k, 10 - k) for k in range(1, 9)] if s else [(5, 4), (1, 9)]
        assert math.isclose(sum(n * k * min(2, math.exp(lam[s] * k / mean)) for k, n in rows), want[s], rel_tol=1e-6)


def test_snapshots_collapse(spark):
    r = random.Random(9)
    talks = [[(r.choice(["user", "assistant"]), r.choice(["hi", "yo", "é", ""])) for _ in range(r.randint(1, 5))] for _ in range(150)]
    talks += [[("user", f"turn {k}") for k in range(n)] for n in (300, 200, 64, 65)] + [talks[0]]
    rows = [(i, k * (1 + i % 3), role, text) for i, t in enumerate(talks) for k, (role, text) in enumerate(t)]
    df = spark.createDataFrame(rows + rows[:40] + [(None, 0, "user", None), (None, None, None, "x<|im_end|>"), (900, 0, "user", None)], "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "block": F.lit(2)})
    got = {x.conv_id: x for x in chat.render(chat.collapse_snapshots(df)).collect()}
    whole = {i: tuple(t) for i, t in enumerate(talks)} | {None: (("user", None), (None, "x<|im_end|>")), 900: (("user", None),)}
    keep = {}
    for i, t in whole.items():
        if not any(len(o) > len(t) and o[: len(t)] == t for o in whole.values()):
            keep.setdefault(t, []).append(i)
    assert set(got) == {min(ids, key=lambda i: (i is None, i or 0)) for ids in keep.values()}
    for t, ids in keep.items():
        x = got[min(ids, key=lambda i: (i is None, i or 0))]
        lines = [f"<|im_start|>{a or ''}\n{(b or '').replace('<|im_end|>', '< |im_end|>')}<|im_end|>\n" for a, b in t]
        assert x.rendered == "".join(lines) and x.n_turns == len(t) and x.copies == len(ids)
    assert chat.render(chat.collapse_snapshots(df.limit(0))).count() == 0


def test_one_conversation_may_be_everything(spark):
    """Turns without a number, of one number, and of one number and role; long texts; the same cut short."""
    long = "x" * 200_000
    turns = {1: [(None, "user", f"t{k:03}") for k in range(700)], 2: [(7, "user", f"t{k:03}") for k in range(699)], 3: [(7, f"r{k % 3}", f"t{k}") for k in range(300)], 4: [(0, "user", long), (1, None, None)], 5: [(0, "user", long)]}
    rows = [(i, *x) for i, t in turns.items() for x in t]
    df = spark.createDataFrame(rows + rows[:100], "conv_id long, turn long, role string, text string").repartition(6)
    h = {(x.conv_id, x.pos): (x.turns, x.h1) for x in chat.prefix_hashes(df).collect()}
    assert len(h) == len(rows) and h[1, 700][0] == 700 and all(h[1, k][1] == h[2, k][1] for k in range(1, 700)) and h[4, 1][1] == h[5, 1][1]
    got = {x.conv_id: x for x in chat.render(chat.collapse_snapshots(df)).collect()}
    assert {i: x.n_turns for i, x in got.items()} == {1: 700, 3: 300, 4: 2}
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[3].rendered == "".join(line(r, t) for _, r, t in sorted(turns[3])) and got[4].rendered == line("user", long) + line("", "")
    workers = chat.render(chat.collapse_snapshots(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in workers and "Arrow" not in workers


def test_media_round_trip(spark):
    r = random.Random(10)
    raws = [None, b"", b"x", bytes(range(256)) * 3, b"\xff" * 5000, r.randbytes(64), r.randbytes(4096), r.randbytes(4097), r.randbytes(300_000), "é\n".encode() * 9000]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None, "c") for i, x in enumerate(raws)], "doc_id long, data binary, clips string")
    encoded = media.encode_avi(df)
    got = {x.doc_id: x for x in media.decode_avi(encoded).collect()}
    stored = {x.doc_id: bytes(x.media) for x in encoded.collect()}
    for i, x in enumerate(raws):
        x = x or b""
        padded = x + b"\0" * (-len(x) % 64 or 64 * (not x))
        g = got[i]
        assert (g.error, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (None, len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert sum(c.frames for c in g.clips) == len(media.read_riff(stored[i])["frames"]) and g.clips[0].start_s == 0
    assert [c.clip for c in media.clip_rows(media.decode_avi(encoded.where("doc_id = 8"))).collect()] == list(range(len(got[8].clips)))
    broken = spark.createDataFrame([(1, bytearray(b"no film")), (2, bytearray(stored[3][:200])), (3, None), (4, bytearray(stored[8][:9000]))], "doc_id long, media binary")
    bad = {x.doc_id: x for x in media.decode_avi(broken).collect()}
    assert "ValueError" in bad[1].error and bad[3].media_bytes is None and len(bad) == 4
    assert media.decode_avi(media.encode_avi(df.limit(0))).count() == 0


def test_media_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, bytearray(b"a")), (1, bytearray(b"a")), (2, bytearray(b"a")), (None, None), (None, None)], "doc_id long, data binary")
    got = media.decode_avi(media.encode_avi(df)).collect()
    assert sorted((x.doc_id or 0) for x in got) == [0, 0, 1, 1, 2]
    assert len({x.media_sha256 for x in got if x.doc_id}) == 1 and all(x.error is None and x.payload_bytes == 64 for x in got)


def huffman(symbols):
    """A table of the given lengths, and its codes: {symbol: bits}."""
    counts, order, code, out = [0] * 16, [], 0, {}
    for length in range(1, 17):
        for s in sorted(s for s, n in symbols.items() if n == length):
            out[s] = f"{code:0{length}b}"
            counts[length - 1] += 1
            order.append(s)
            code += 1
        code <<= 1
    return bytes(counts) + bytes(order), out


def test_any_baseline_jpeg_decodes(spark):
    """A colour frame with 2x1 luma sampling, quantisers, zero runs and two code tables, written bit by bit."""
    r = np.random.default_rng(11)
    dc, dc_codes = huffman({k: 4 for k in range(12)})
    ac, ac_codes = huffman({0: 2, 0xF0: 6, **{run << 4 | size: 7 + (run > 2) for run in range(8) for size in range(1, 5)}})
    width, height, across, down = 30, 13, 2, 2
    luma = r.integers(-9, 10, (down, across * 2, 64)) * (r.random((down, across * 2, 64)) < 0.2)
    chroma = r.integers(-3, 4, (2, down, across, 64)) * (r.random((2, down, across, 64)) < 0.1)
    bits, before = "", [0, 0, 0]

    def number(v):
        size = int(abs(v)).bit_length()
        return size, (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    def block(c, b):
        size, extra = number(int(b[0]) - before[c])
        before[c], out, run = int(b[0]), dc_codes[size] + extra, 0
        last = max([k for k in range(1, 64) if b[k]], default=0)
        for k in range(1, last + 1):
            if not b[k]:
                run += 1
                continue
            while run > 15 or run > 7 and run % 16 > 7:
                raise AssertionError
            size, extra = number(int(b[k]))
            out, run = out + ac_codes[run << 4 | size] + extra, 0
        return out + (ac_codes[0] if last < 63 else "")

    for b in [*luma.reshape(-1, 64), *chroma.reshape(-1, 64)]:
        run = 0
        for k in range(1, 64):  # keep zero runs within the table
            run = 0 if b[k] else run + 1
            if run > 6:
                b[k], run = 1, 0
    for y in range(down):
        for x in range(across):
            bits += block(0, luma[y, 2 * x]) + block(0, luma[y, 2 * x + 1]) + block(1, chroma[0, y, x]) + block(2, chroma[1, y, x])
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    quant = bytes([0] + [3] * 64)
    seg = media._segment
    sof = seg(0xC0, bytes([8, 0, height, 0, width, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]))
    jpeg = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, quant) + sof + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    head = media.Jpeg(jpeg)
    assert not head.even and (head.luma(jpeg[head.start : -2]) == luma.reshape(-1, 64)).all()
    units, hist = next(media.decode_frames(jpeg, [(0, len(jpeg))]))
    u = np.cos((2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
    raster = np.zeros((8, 64))
    raster[:, media.zigzag()] = luma.reshape(-1, 64) * 3
    pixels = np.clip(np.rint(np.einsum("bvu,vy,ux->byx", raster.reshape(-1, 8, 8), u, u) + 128), 0, 255)
    assert (hist[0] == np.histogram(pixels, bins=media.BINS, range=(0, 256))[0]).all()


def test_foreign_films(spark):
    """Frames of two kinds in turn stay in order; frames of a second RIFF chunk count; typical code tables are known."""
    one, two = bytes(range(64)) * 4, bytes(64) * 7
    films = [media.write_avi(x) for x in (one, two)]
    frames = [f[a:b] for f in films for a, b in media.read_riff(f)["frames"]]
    mixed = [frames[0], frames[1], frames[0], frames[0], frames[1]]
    whole = b"".join(mixed)
    ends = np.cumsum([len(f) for f in mixed]).tolist()
    units = b"".join(u.tobytes() for u, _ in media.decode_frames(whole, list(zip([0, *ends], ends, strict=False))))
    short = lambda x: x + bytes(-len(x) % 512)
    assert units == short(one) + short(two) + short(one) * 2 + short(two)
    more = media._chunk(b"RIFF", b"AVIX" + media._chunk(b"LIST", b"movi" + b"".join(media._chunk(b"00dc", f) for f in (frames[1], frames[0]))))
    riff = media.read_riff(films[0] + more)
    assert [(films[0] + more)[a:b] for a, b in riff["frames"]] == [frames[0], frames[1], frames[0]]
    for name, codes in media.typical_codes().items():
        assert len(codes) == len(set(codes.values())) == (162 if name & 0x10 else 12) and sum(2.0**-n for n, _ in codes) < 1
    rows = spark.createDataFrame([(1, bytearray(films[0]))] * 3, "doc_id long, media binary")
    assert len({r.payload_sha256 for r in media.decode_avi(rows).collect()}) == 1 and media.decode_avi(rows).count() == 3


def test_shots_stand_out():
    flat = np.tile(np.array([100, 0, 0, 0]), (10, 1))
    other = np.tile(np.array([0, 0, 100, 0]), (5, 1))
    assert media.shots(np.concatenate([flat, other, flat])) == [0, 10, 15]
    assert media.shots(flat) == [0] and media.shots(flat[:1]) == [0]
    drift = np.array([[100 - k, k] for k in range(100)])
    assert media.shots(drift) == [0]
