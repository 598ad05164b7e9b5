"""Distributed forms against plain loops on small random inputs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.functions import scan
from reelspark.functions.intervals import interval_join, near_join
from reelspark.functions.scan import Scan, prefix_scan
from reelspark.operators import cues as C
from reelspark.operators import fusion as FU
from reelspark.operators import timeline as TL

CAND = "project_id long, ord long, label string, start_s double, end_s double, evidence string, score double, kind string"


def random_candidates(rng, projects, most, kind):
    rows = []
    for p in range(projects):
        for o in range(rng.randint(0, most)):
            a = rng.randint(0, 400) / 4
            rows.append((p, o, f"{kind}{o}", a, a + rng.randint(0, 60) / 4, rng.choice(["", "e"]), rng.randint(0, 20) / 20, kind))
    return rows


def fuse_one_project(text, visual):
    """Groups in order of creation; a visual joins the first text group it can reach, replacing its visual."""
    groups = [{"t": t, "v": None} for t in text]
    for v in visual:
        for g in groups:
            t = g["t"]
            if t and min(t[4] - t[3], v[4] - v[3]) > 0 and t[3] <= v[4] + 2 and v[3] <= t[4] + 2:
                g["v"] = v
                break
        else:
            groups.append({"t": None, "v": v})
    out = []
    for n, g in enumerate(groups, 1):
        t, v = g["t"], g["v"]
        score = min(1.0, (t[6] + v[6]) / 2 + 0.1) if t and v else (t or v)[6]
        lo = min(x[3] for x in (t, v) if x)
        hi = max(x[4] for x in (t, v) if x)
        out.append((f"fused-{n:03d}", lo, hi, score))
    return sorted(out, key=lambda x: -x[3])[:6]


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 4])
def test_fusion(spark, monkeypatch, rows_per_slice):
    monkeypatch.setattr(scan, "ROWS_PER_SLICE", rows_per_slice)
    rng = random.Random(7)
    text, visual = random_candidates(rng, 60, 8, "text"), random_candidates(rng, 60, 14, "gameplay")
    got = {}
    for r in FU.fuse_evidence(spark.createDataFrame(text, CAND), spark.createDataFrame(visual, CAND)).orderBy("project_id", "rank").collect():
        got.setdefault(r["project_id"], []).append((r["id"], r["start_s"], r["end_s"], r["score"]))
    for p in range(60):
        assert got.get(p, []) == fuse_one_project([t for t in text if t[0] == p], [v for v in visual if v[0] == p])


@pytest.mark.parametrize("top", [FU.TOP_LIST, 2, 1])
def test_near_duplicates(spark, top):
    rng = random.Random(3)
    rows = [(p, f"d{p}-{o}", o, float(a), float(a + n), s) for p in range(30) for o in range(25) for a, n, s in [(rng.randint(0, 40), rng.randint(1, 20), rng.choice([None, 0.2, 0.5, 0.9]))]]
    df = spark.createDataFrame(rows, "project_id long, draft_id string, ord long, start_s double, end_s double, score double")
    got = {}
    for r in FU.suppress_near_duplicates(df, top=top).orderBy("project_id", "rank").collect():
        got.setdefault(r["project_id"], []).append(r["draft_id"])
    for p in range(30):
        kept = []
        for r in sorted((x for x in rows if x[0] == p), key=lambda x: (-(x[5] or 0.0), x[2])):
            clash = any(min(r[4], k[4]) - max(r[3], k[3]) > 0.8 * min(r[4] - r[3], k[4] - k[3]) for k in kept)
            if not clash:
                kept.append(r)
            if len(kept) == 6:
                break
        assert got[p] == [k[1] for k in kept]


def random_cues(rng, projects, most):
    rows = []
    for p in range(projects):
        spans = sorted((a, a + rng.randint(1, 40)) for a in (rng.randint(0, 800) for _ in range(rng.randint(1, most))))
        rows += [(p, i, a / 4, b / 4, f"c{i}") for i, (a, b) in enumerate(spans)]
    return rows


CUE = "project_id long, cue_idx int, start_s double, end_s double, text string"


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 5])
def test_snap(spark, monkeypatch, rows_per_slice):
    monkeypatch.setattr(scan, "ROWS_PER_SLICE", rows_per_slice)
    rng = random.Random(11)
    cues = random_cues(rng, 20, 12)
    points = [(p, side, rng.randint(-20, 1000) / 4, n) for p in range(20) for n in range(15) for side in ("start", "end")]
    df = C.snap_to_cues(spark.createDataFrame(points, "project_id long, side string, t double, n int"), spark.createDataFrame(cues, CUE))
    got = {(r["project_id"], r["side"], r["n"]): r["snapped"] for r in df.collect()}
    for p, side, t, n in points:
        mine = [c for c in cues if c[0] == p]
        at = 2 if side == "start" else 3
        best = min(mine, key=lambda c: abs(c[at] - t))  # min keeps the first of equals
        if abs(best[at] - t) <= 3:
            want = best[at]
        else:
            holding = [c for c in mine if c[2] <= t <= c[3]] or [c for c in mine if c[3] >= t] or [mine[-1]]
            want = holding[0][at]
        assert got[(p, side, n)] == want, (p, side, t)


def test_coverage_and_excerpt(spark):
    rng = random.Random(5)
    cues = random_cues(rng, 20, 15)
    spans = [(p, n, a / 4, (a + rng.randint(1, 600)) / 4) for p in range(20) for n in range(8) for a in [rng.randint(0, 700)]]
    c = spark.createDataFrame(cues, CUE)
    s = spark.createDataFrame(spans, "project_id long, span_id int, start_s double, end_s double")
    cov = {(r["project_id"], r["span_id"]): r["coverage"] for r in TL.speech_coverage(s, c).collect()}
    exc = {(r["project_id"], r["span_id"]): r["evidence"] for r in TL.evidence_excerpt(s, c).collect()}
    for p, n, a, b in spans:
        quarter = [any(x[2] <= q / 4 and x[3] >= (q + 1) / 4 for x in cues if x[0] == p) for q in range(int(a * 4), int(b * 4))]
        assert cov[(p, n)] == pytest.approx(sum(quarter) / len(quarter))
        assert exc[(p, n)] == " ".join(x[4] for x in cues if x[0] == p and x[2] < b and x[3] > a)


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_scan_equals_plain_windows(spark, descending):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 50), i, rng.choice([None, 1, 5, 9, rng.randint(0, 100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v int").withColumn("b", F.floor(F.col("t") / 7))
    scans = [Scan("n", "count"), Scan("total", "sum", F.col("v")), Scan("top", "max", F.col("v")), Scan("prev", "lag", F.col("v")), Scan("seen", "last", F.col("v"))]
    got = prefix_scan(df, ["k"], "b", ["t", "i"], scans, descending=descending)
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    w = Window.partitionBy("k").orderBy(direction("t"), direction("i"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("total"), F.max("v").over(before).alias("top"),
        F.lag("v").over(w).alias("prev"), F.last("v", ignorenulls=True).over(before).alias("seen"),
    )
    order = lambda d: sorted((tuple(r) for r in d.select(*want.columns).collect()), key=repr)
    assert order(got) == order(want)


@pytest.mark.parametrize("pad", [0.0, 2.0])
def test_interval_join_finds_every_pair_once(spark, pad):
    rng = random.Random(2)
    spans = lambda n, top: [(rng.randint(0, 2), i, a / 2, (a + rng.randint(0, top)) / 2) for i in range(n) for a in [rng.randint(0, 900)]]
    left, right = spans(80, 300), spans(80, 40)
    l = spark.createDataFrame(left, "k int, li int, ls double, le double")
    r = spark.createDataFrame(right, "k int, ri int, rs double, re double")
    got = sorted((x["li"], x["ri"]) for x in interval_join(l, r, ["k"], ("ls", "le"), ("rs", "re"), width=30.0, pad=pad).collect())
    assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and b[2] <= a[3] + pad and b[3] >= a[2] - pad)


def test_near_join_finds_every_pair_once(spark):
    rng = random.Random(4)
    left = [(rng.randint(0, 1), i, rng.randint(0, 3000) / 100) for i in range(150)]
    right = [(rng.randint(0, 1), i, rng.randint(0, 3000) / 100) for i in range(150)]
    got = sorted((r["a"], r["b"]) for r in near_join(spark.createDataFrame(left, "k int, a int, x double"), spark.createDataFrame(right, "k int, b int, y double"), ["k"], "x", "y", 0.05).collect())
    assert got == sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and abs(p[2] - q[2]) <= 0.05)


def refine_one_project(items, cues, lo, hi):
    """The four phases as one loop over the spans of one project, working on cue lists directly."""
    first, last = cues[0][2], max(c[3] for c in cues)

    def snap(t, at):
        near = min(cues, key=lambda c: abs(c[at] - t))
        if abs(near[at] - t) <= 3:
            return near[at]
        return ([c for c in cues if c[3] >= t] or [cues[-1]])[0][at]

    spans = sorted((snap(max(first, a), 2), snap(min(last, b), 3)) for a, b in items)
    if any(b <= a for a, b in spans):
        return None
    flat = []
    for a, b in spans:
        if flat and min(flat[-1][1], b) > a:
            p = flat[-1]
            free = [c[2] for c in cues if p[1] <= c[2] < b]
            if (min(p[1], b) - a) / min(p[1] - p[0], b - a) >= 0.5 or not free:
                p[1] = max(p[1], b)
                continue
            a = free[0]
        flat.append([a, b])
    for s, following in zip(flat, flat[1:] + [[last, last]]):
        for c in cues:
            if s[1] - s[0] < lo and c[3] > s[1] and c[2] - s[1] <= 5 and c[3] <= following[0] and c[3] - s[0] <= hi:
                s[1] = c[3]
    done, queue = [], flat
    while queue:
        s, queue = list(queue[0]), queue[1:]
        while s[1] - s[0] < lo and queue and queue[0][0] - s[1] <= 5 and queue[0][1] - s[0] <= hi:
            s[1], queue = queue[0][1], queue[1:]
        quarters = range(round(s[0] * 4), round(s[1] * 4))
        spoken = sum(any(c[2] <= q / 4 and c[3] >= (q + 1) / 4 for c in cues) for q in quarters)
        if s[1] - s[0] < lo:
            if done and s[0] - done[-1][1] <= 5 and s[1] - done[-1][0] <= hi:
                done[-1][1] = max(done[-1][1], s[1])
        elif spoken * 2 >= len(quarters):
            done.append(s)
    return [tuple(x) for x in done]


def test_refine(spark):
    rng = random.Random(13)
    cues, items, profile = random_cues(rng, 60, 25), [], []
    for p in range(60):
        mine = [c for c in cues if c[0] == p]
        top = max(c[3] for c in mine)
        for o in range(rng.randint(1, 7)):
            a = rng.randint(int(mine[0][2] * 4), int(top * 4) - 1) / 4
            items.append((p, o, f"T{o}", a, max(a, mine[0][2]) + rng.randint(1, 200) / 4))
        profile.append((p, float(rng.choice([2, 10, 25])), float(rng.choice([30, 60])), 1800.0))
    rows, report = TL.refine_timeline(
        spark.createDataFrame(items, "project_id long, ord int, label string, start_s double, end_s double"), spark.createDataFrame(cues, CUE),
        spark.createDataFrame(profile, "project_id long, min_s double, max_s double, hard_max_s double"),
    )
    got = {}
    for r in rows.orderBy("project_id", "ord").collect():
        got.setdefault(r["project_id"], []).append((r["start_s"], r["end_s"]))
    reasons = {r["project_id"]: r["reason"] for r in report.collect()}
    assert set(reasons) == set(range(60))
    for p in range(60):
        if reasons[p] == "reversed_or_outside":
            continue
        want = refine_one_project([(i[3], i[4]) for i in items if i[0] == p], [c for c in cues if c[0] == p], profile[p][1], profile[p][2])
        assert got.get(p) == (want or None), (p, reasons[p])


@pytest.mark.parametrize("per_fold", [20_000, 3])
def test_chunks(spark, monkeypatch, per_fold):
    monkeypatch.setattr(C, "CUES_PER_FOLD", per_fold)
    monkeypatch.setattr(scan, "ROWS_PER_SLICE", 6)
    rng = random.Random(8)
    rows = []
    for p, n in enumerate([1, 3, 40, 90]):
        spans = sorted((a, a + rng.choice([1, 20, 500])) for a in (rng.randint(0, 2000) for _ in range(n)))
        rows += [(p, i, a / 4, b / 4, "x" * rng.choice([1, 30, 200])) for i, (a, b) in enumerate(spans)]
    got = {(r["project_id"], r["cue_idx"]): r["chunk"] for r in C.chunk_cues(spark.createDataFrame(rows, CUE), 60.0, 300, 10).collect()}
    want = {}
    for p in range(4):
        chunk, t, size = -1, 0.0, 0
        for _, i, a, b, text in (r for r in rows if r[0] == p):
            cost = len(text) + 10
            if chunk < 0 or b - t > 60 or size + cost > 300:
                chunk, t, size = chunk + 1, a, 0
            size += cost
            want[(p, i)] = chunk
    assert got == want


def test_excerpt_reads_no_text_past_its_limit(spark):
    rng = random.Random(6)
    cues = [(0, i, i * 2.0, i * 2.0 + 3, " " + "é" * rng.choice([1, 2, 3, 40, 400, 1500]) + "\u3000") for i in range(300)]
    spans = [(0, n, float(a), float(a + rng.randint(1, 500))) for n, a in enumerate(range(0, 550, 25))] + [(1, 0, 0.0, 9.0)]
    got = TL.evidence_excerpt(spark.createDataFrame(spans, "project_id long, span_id int, start_s double, end_s double"), spark.createDataFrame(cues, CUE))
    for r in got.collect():
        mine = [c[4].strip() for c in cues if c[0] == r["project_id"] and c[2] < r["end_s"] and c[3] > r["start_s"]]
        assert r["evidence"] == " ".join(mine)[:1000]
