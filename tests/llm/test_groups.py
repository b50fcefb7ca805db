"""P3 against union-find."""

import random
from collections import Counter, defaultdict

from lectern.llm import group_split

SCHEMA = "utt_id string, dataset string, speaker string, split string, root long, size int"


def code(s):
    import re

    s = re.sub("^SPK[-_:]", "", (s or "").strip().upper())
    return s if s not in ("", "UNKNOWN") else None


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for utt, dataset, speaker, *_ in rows:
        if utt is None:
            continue
        rec = "r:" + utt.rpartition("_")[0] if "_" in utt else "r:" + utt
        find(rec)
        parts = utt.split("_")
        for c in (code(speaker), code(parts[1]) if dataset == "l2arctic" and len(parts) > 1 else None):
            if c:
                up[find("c:" + c)] = find(rec)
    groups = defaultdict(list)
    for x in list(up):
        groups[find(x)].append(x)
    key = {k: min(v)[2:] for k, v in groups.items()}
    return {u: key[find("r:" + u.rpartition("_")[0] if "_" in u else "r:" + u)] for u, *_ in rows if u is not None}


def check(spark, rows):
    got = group_split.assign_splits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.utt_id: r.group_key for r in got} == brute(rows)
    assert len(got) == len({r.utt_id for r in got})
    splits = defaultdict(set)
    for r in got:
        splits[r.group_key].add(r.split)
    assert all(len(s) == 1 for s in splits.values())
    return got


def test_components(spark):
    r = random.Random(5)
    rows = []
    for i in range(500):
        d = r.choice(["l2arctic", "edacc"])
        speaker = r.choice([None, " ", "unknown", f"spk_a{r.randrange(70)} ", f"A{r.randrange(70)}", f"SPK:b{r.randrange(9)}"])
        rows.append((f"{d}_{r.choice('XYZ')}{r.randrange(60)}_r{r.randrange(90)}_{i}", d, speaker, None, 1, 2))
    check(spark, rows + rows[:40] + [(None, "edacc", "A1", None, 0, 0), ("plain", "edacc", None, None, 0, 0), ("solo", "l2arctic", None, None, 0, 0)])


def test_long_chain_and_hub(spark):
    chain = [(f"e_r{i // 2}_{i}", "edacc", f"C{(i + 1) // 2:03}", None, 1, 1) for i in range(120)]
    hub = [(f"e_h{i}_0", "edacc", "HUB", None, 1, 1) for i in range(150)]
    check(spark, chain + hub)


def test_shares(spark):
    rows = [(f"e_r{i % 400}_{i}", "edacc", None, None, 1, 1) for i in range(4000)] + [(f"e_big_{i}", "edacc", None, None, 1, 1) for i in range(600)]
    got = check(spark, rows)
    n = Counter(r.split for r in got)
    for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(n[split] / len(got) - share) < 0.02


def test_spanning_forest(spark):
    r = random.Random(2)
    edges = [(f"a{r.randrange(80)}", f"b{r.randrange(80)}") for _ in range(150)]
    label, forest = group_split.spanning_forest(spark.createDataFrame(edges, "u string, v string"))
    labels, tree = {x.v: x.root for x in label.collect()}, {tuple(sorted(x)) for x in forest.collect()}
    assert len(tree) == len(labels) - len(set(labels.values()))  # as many edges as a forest of these components has
    assert tree <= {tuple(sorted(e)) for e in edges}


def test_empty(spark):
    assert group_split.assign_splits(spark.createDataFrame([], SCHEMA)).collect() == []
