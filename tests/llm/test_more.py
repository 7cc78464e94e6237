"""Whole scores, pruning, bounded blocks, kept caches and the pipeline's edges, each against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import common, mtree, neardup, packing, secrets, tokencount, toxicity, warc


def clustered(rng, clusters, each, dim):
    centers = rng.normal(size=(clusters, dim)) * 300
    return np.floor(np.concatenate([c + rng.normal(size=(each, dim)) * 5 for c in centers])).astype(np.int64)


def test_tree_computes_few_distances():
    rng = np.random.default_rng(2)
    points = clustered(rng, 16, 250, 16)
    tree = mtree.MTree.load(mtree.MTree.build(points, np.arange(len(points))).dump())
    asked = np.arange(0, len(points), 50)
    best = mtree.Best(asked, np.full(len(asked), mtree.NONE), 5)
    tree.search_block(points[asked].astype(float), best)
    scores = points[asked] @ points.T
    want = [(i, j, int(scores[i, j])) for i in range(len(asked)) for j in sorted((j for j in range(len(points)) if j != asked[i]), key=lambda j: (-scores[i, j], j))[:5]]
    assert best.rows() == want
    share = tree.computed / (len(asked) * len(points))
    assert share < 0.2, share


@pytest.mark.parametrize("small", [{"TREE_ROWS": 40, "BLOCK": 8, "UNIT": 2, "DEAL_ROWS": 100}, {"TREE_ROWS": 100, "LEAF": 16, "PIVOTS": 3}])
def test_topk_over_many_trees(spark, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(3)
    points = clustered(rng, 9, 100, 6) / 256
    points[300:500] = points[300]  # copies that no pivot cuts
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * points).astype(np.int64)
    want = set()
    for q in range(0, len(points), 50):
        s = whole @ whole[q]
        want |= {(q, r + 1, j, int(s[j])) for r, j in enumerate(sorted((j for j in range(len(points)) if j != q), key=lambda j: (-s[j], j))[:5])}
    found = mtree.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def near_texts(rng, groups, copies, words=60):
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(groups):
        base = list(rng.choice(vocabulary, words))
        for _ in range(copies):
            copy = list(base)
            for at in rng.choice(words, rng.integers(0, 4), replace=False):
                copy[at] = str(rng.choice(vocabulary[:20]))
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("volume, hub_rows", [(1_000_000, 1024), (200, 3)])
def test_near_classes_in_small_blocks(spark, monkeypatch, volume, hub_rows):
    monkeypatch.setattr(neardup, "VOLUME", volume)
    monkeypatch.setattr(neardup, "HUB_ROWS", hub_rows)
    texts = near_texts(np.random.default_rng(8), 3, 40)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    memo, sets = {}, []
    for t in texts:
        _, h, w = neardup.shingles([neardup.words_of(t)], memo)
        sets.append((h, w))
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if neardup.similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    found = {r.doc_id: r.class_id for r in neardup.near_classes(frame).collect()}
    assert found == {i: top(i) for i in range(len(texts))} and len(set(found.values())) > 3


def test_scratch_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    import sys

    storage = sys.modules.get("lodestack.storage")
    if storage is not None:
        monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    frame = spark.createDataFrame(list(enumerate(near_texts(np.random.default_rng(1), 4, 5))), "doc_id long, text string")
    kept = neardup.dedup(frame)
    assert kept.count() > 0
    assert {p.name.split("-")[1] for p in tmp_path.iterdir()} <= {"classes", "twice"}


def test_toxicity_score_by_brute_force(spark):
    rng = np.random.default_rng(11)
    plain, bad = [f"calm{i}" for i in range(80)], ["vile", "nasty", "awful"]
    docs, labels = [], []
    for i in range(300):
        w = [str(x) for x in rng.choice(plain, 30)]
        if i % 3 == 0:
            w[5:8] = rng.choice(bad, 3).tolist()
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    counts = [Counter(), Counter()]
    for (i, t), (_, y) in zip(docs, labels):
        if 1 <= zlib.crc32(str(i).encode()) % 5 <= 3:
            for w in t.split():
                counts[y].update(toxicity.features(w.encode()))
    total = [sum(c.values()) for c in counts]
    prior = toxicity.PRIOR_SHARE * min(total)
    scores = {}
    for f in set(counts[0]) | set(counts[1]):
        a = prior * (counts[0][f] + counts[1][f]) / sum(total)
        part = [math.log((counts[y][f] + a) / (total[y] + prior - counts[y][f] - a)) for y in (0, 1)]
        off = toxicity.SIGMAS * math.sqrt(1 / (counts[1][f] + a) + 1 / (counts[0][f] + a))
        scores[f] = max(0.0, part[1] - part[0] - off) + min(0.0, part[1] - part[0] + off)
    assert all(abs(model.scores[f] - s) < 1e-4 for f, s in scores.items()) and np.count_nonzero(model.scores) == sum(s != 0 for s in scores.values())

    def token(w):
        each = [float(model.scores[f]) for f in toxicity.features(w.encode())]
        return (max(each) if max(each) > 0 else each[0]) - model.drift

    def maximal(s, low, high):  # the best segment, then what is left of it and right of it
        best = max(((round(sum(s[i:j]), 9), i - j, -i) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, n = -best[2], -best[1]
        return maximal(s, low, i) + [sum(s[i : i + n])] + maximal(s, i + n, high)

    found = {r.doc_id: r for r in toxicity.toxicity_report(frame, model).collect()}
    for i, t in docs[:60]:
        words = t.split()
        strong = [model.rate * s - model.log_k - math.log(len(words)) for s in maximal([token(w) for w in words], 0, len(words))]
        passages = [e for e in strong if e > -math.log(model.significant)]
        x = [math.log1p(max([e for e in strong if e > 0], default=0.0)), math.log1p(sum(passages)), math.log1p(len(passages))]
        p = 1 / (1 + math.exp(-float(np.dot(model.weights[:-1], x) + model.weights[-1])))
        assert abs(found[i].score - p) < 1e-6 and found[i].n_passages == len(passages)


def test_warc_records_have_their_own_identifiers(spark, tmp_path):
    html = "<p>x</p>" * 40
    rows = [(1, "a", html), (1, "b", html), (1, "c", "other"), (None, "d", "e"), (None, "e", "f"), (9, "f", html)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    manifest, folder = warc.archive_pages(spark.read.parquet(path), str(tmp_path / "w"))
    found = warc.read_archives(manifest, folder).collect()
    assert len({r.record_id for r in found}) == len(rows)
    import gzip

    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz")).decode()
    refers = [line.split(": ")[1].strip() for line in text.splitlines() if line.startswith("WARC-Refers-To:")]
    assert len(refers) == 1 and refers[0] in {r.record_id for r in found if r.page_id == 1}
    assert "1970" not in text


def test_cache_is_kept(spark, monkeypatch, tmp_path):
    frame = spark.createDataFrame([(1, "some words"), (2, "some words"), (3, None)], "doc_id long, text string")
    monkeypatch.setattr(tokencount, "shared_dir", lambda spark: str(tmp_path))
    first = sorted(map(tuple, tokencount.token_counts(frame).collect()))
    stored = spark.read.parquet(str(next(tmp_path.iterdir()))).count()
    again = sorted(map(tuple, tokencount.token_counts(frame.union(frame)).collect()))
    assert again == sorted(first * 2) and stored == 2
    assert spark.read.parquet(str(next(tmp_path.iterdir()))).count() == stored


def test_a_process_loads_a_tokenizer_once(monkeypatch, tmp_path):
    import os
    import shutil

    import tokenizers

    file, library, loads = tmp_path / tokencount.TOKENIZER, tokenizers.Tokenizer, []
    shutil.copy(tokencount.tokenizer_file(tokencount.TOKENIZER), file)

    class Counted:
        @staticmethod
        def from_file(path):
            loads.append(path)
            return library.from_file(path)

    monkeypatch.setenv("LODESTACK_TOKENIZERS", str(tmp_path))
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    texts = ["one text", "", "another\u00a0one " * 9, "<|endoftext|>"]
    found = [tokencount.counter()(texts) for _ in range(3)]
    assert loads == [str(file)]
    os.utime(file, ns=(1, 1))  # another version of the file
    found.append(tokencount.counter()(texts))
    assert len(loads) == 2 and found == [[len(library.from_file(str(file)).encode(t, add_special_tokens=False)) for t in texts]] * 4


SPACED = ["  lead and\ttrail \n", "one", None, "", " \n ", "é " * 50, "x" * 400, " ".join(f"word{i}" for i in range(500))]


@pytest.mark.parametrize("tokenizer", [None, tokencount.TOKENIZER])
def test_pieces_are_the_text(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SPACED)] + [(7, SPACED[7], 2), (None, "no id", 3)], "doc_id long, text string, length int")
    found = packing.pack(docs, tokenizer, max_len=64, buckets=3, budget=256, shard_batches=2).collect()
    count = tokencount.counter(tokencount.TOKENIZER) if tokenizer else (lambda texts: [len([w for w in t.encode().split()]) for t in texts])
    for i, t in enumerate(SPACED):
        mine = sorted((r.copy or 0, r.piece, r.text, r.length, r.start) for r in found if r.doc_id == i)
        first = [x for x in mine if x[0] == 0]
        assert "".join(x[2] or "" for x in first) == (t or "") and [x[1] for x in first] == list(range(len(first)))
        assert [x[3] for x in first] == count([x[2] or "" for x in first]) and all(x[3] <= 64 for x in first)
        assert [x[4] for x in first] == [sum(x[3] for x in first[:j]) for j in range(len(first))]
        assert len(mine) == len(first) * (2 if i == 7 else 1)
    assert [r.text for r in found if r.doc_id is None] == ["no id"]


def test_planted_secrets():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("con", "per", "stra", "ver", "plo") for b in ("ten", "lic", "mo", "tion", "sar")]
    prose = lambda: " ".join(rng.choice(words, 40))
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    key = lambda n: "".join(rng.choice(letters, n))
    heads = ["Authorization: Bearer ", "private_key = '", "client_key: ", 'passphrase: "', "session_id="]
    hit, wrong, total = 0, 0, 0
    for i in range(400):
        head, value = heads[i % len(heads)], key(int(rng.integers(20, 60)))
        text = f"{prose()} {head}{value}{head[-1] if head[-1] in chr(39) + chr(34) else ''} {prose()}"
        spans = [(a, b) for a, k, b in secrets.scan(text)[1] if k == "novel"]
        at = text.index(value)
        hit += (at, at + len(value)) in spans
        wrong += len([s for s in spans if s != (at, at + len(value))])
        total += 1
        clean = f"{prose()} the signature of {prose()} cookie: {'-'.join(rng.choice(words, 3))} {prose()}"
        wrong += len(secrets.scan(clean)[1])
    assert hit / total >= 0.98 and wrong / total <= 0.06, (hit, wrong, total)
