"""The pipeline, stage by stage, against plain versions on the small corpus."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from palimpsest.llm import mixing, near_dedup, packing, quality, toxicity  # noqa: E402
from palimpsest.llm.sampling import held_out  # noqa: E402
from palimpsest.session import table, written  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), name))
    return [[r.asDict() for r in d.collect()] for d in out], [d.columns for d in out]


def test_columns(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[:5]) and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "minhash_near_dedup", "mixing", "packing"]


def shrink(sites, prior):
    """sites: key to (good, n); prior: key to rate."""
    n = sum(x for _, x in sites.values())
    spread = sum(x * (g / x - prior[k]) ** 2 for k, (g, x) in sites.items())
    within = sum(x * prior[k] * (1 - prior[k]) for k, (_, x) in sites.items())
    tau2 = max((spread - within * len(sites) / n) / n, 1e-9)
    m = min(max(within / n / tau2 - 1, quality.STRENGTH[0]), quality.STRENGTH[1])
    return {k: (g + m * prior[k]) / (x + m) for k, (g, x) in sites.items()}


def test_quality(spark, sf_dir, stages):
    before, after = stages[0][0], stages[0][1]
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    e = model.log_odds([d["text"] for d in before])
    hosts, paths = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
    for d, x in zip(before, e, strict=True):
        for sums, key in ((hosts, d["source"]), (paths, (d["source"], d["lang"]))):
            sums[key][0] += 1 / (1 + math.exp(-x))
            sums[key][1] += 1
    base = min(max(sum(g for g, _ in hosts.values()) / len(before), 0.01), 0.99)
    host_rate = shrink(hosts, dict.fromkeys(hosts, base))
    path_rate = shrink(paths, {k: host_rate[k[0]] for k in paths})
    logit = lambda p: math.log(p / (1 - p))
    keep = []
    for d, x in zip(before, e, strict=True):
        site = logit(path_rate[d["source"], d["lang"]]) - logit(base)
        if 1 / (1 + math.exp(-(x + max(-quality.SITE_LIMIT, min(quality.SITE_LIMIT, site))))) >= quality.KEEP:
            keep.append(d["doc_id"])
    assert sorted(keep) == sorted(d["doc_id"] for d in after)


def test_toxicity(spark, sf_dir, stages):
    before, after = stages[0][1], stages[0][2]
    schema = table(spark, sf_dir, "documents").schema
    model = toxicity.train(spark.createDataFrame(before, schema), table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    assert sorted(d["doc_id"] for d in after) == sorted(d["doc_id"] for d in before if model.score(d["text"])[0] < toxicity.THRESHOLD)


def test_near_dedup(stages):
    before, after = stages[0][2], stages[0][3]
    sets = {d["doc_id"]: near_dedup.shingles_of(near_dedup.words_of(d["text"]), 5) for d in before}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert sorted(d["doc_id"] for d in after) == [i for i in ids if root(i) == i]


def fill(budget, children):
    """children: name to (weight, cap). Fills in the order of cap / weight."""
    out, left = {}, budget
    weight = sum(w for w, _ in children.values())
    order = sorted(children, key=lambda k: (children[k][1] / children[k][0], k))
    for i, k in enumerate(order):
        w, cap = children[k]
        if cap <= left / weight * w:
            out[k], left, weight = cap, left - cap, weight - w
        else:
            rest = sorted(order[i:])
            level = left / weight
            share = {x: min(children[x][1], math.floor(level * children[x][0])) for x in rest}
            spare = left - sum(share.values())
            for x in sorted((x for x in rest if children[x][1] > share[x])):
                if spare > 0:
                    share[x], spare = share[x] + 1, spare - 1
            return out | share
    return out


def test_mixing(stages):
    before, after = stages[0][3], stages[0][4]
    leaves = defaultdict(list)
    for d in before:
        n = len(re.findall(mixing.TOKEN, d["text"]))
        domain = "d" + str(ord(hashlib.md5(d["source"].encode()).hexdigest()[0]) % 4)
        if n:
            leaves[domain, d["lang"], d["source"]].append((d["doc_id"], n))
    totals = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budgets = {(): sum(totals.values())}
    for depth in range(3):
        below = defaultdict(lambda: defaultdict(int))
        for k, t in totals.items():
            below[k[:depth]][k[depth]] += t * mixing.MAX_EPOCHS
        weight = (lambda x: 1, lambda x: mixing.LANG_WEIGHTS.get(x, 1), lambda x: 1)[depth]
        budgets = {(*k, c): b for k, caps in below.items() for c, b in fill(budgets[k], {c: (weight(c), cap) for c, cap in caps.items()}).items()}
    want = []
    for k, docs in leaves.items():
        epochs, rest = divmod(budgets[k], totals[k])
        want += [i for i, _ in docs] * epochs
        at = 0
        for i, n in sorted(docs, key=lambda d: (hashlib.md5(f"{mixing.SEED}:{epochs}:{d[0]}".encode()).hexdigest(), str(d[0]), d[1])):
            if at >= rest:
                break
            want.append(i)
            at += n
    assert sorted(want) == sorted(d["doc_id"] for d in after)


def test_packing(stages):
    before, after = stages[0][4], stages[0][5]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d["doc_id"]: np.array(tok.encode(d["text"], add_special_tokens=False).ids + [2], "<u4") for d in before}
    total = sum(len(ids[d["doc_id"]]) for d in before)
    windows, seen = defaultdict(list), defaultdict(int)
    for r in after:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
    copies = defaultdict(int)
    for d in before:
        copies[d["doc_id"]] += 1
    assert seen == {i: n * len(ids[i]) for i, n in copies.items()}
    sizes = []
    for k in sorted(windows):
        at = 0
        for offset, n in sorted(windows[k]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sizes[:-1] == [4096] * (len(sizes) - 1) and sum(sizes) == total
