"""Vector searches against brute force, and the url filter against a plain reading of its rules."""

import re

import numpy as np
import pytest

from tidecast.llm import kmtree, knnjoin, urls


def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12))
    points = (centres[rng.integers(0, 8, 900)] + 0.4 * rng.normal(size=(900, 12))).astype(np.float32)
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    rows += [(1000 + i, points[3].tolist(), 0) for i in range(300)]  # one very common vector
    rows += [(2000, None, 0), (2020, [float("nan")] * 12, 0), (2040, [1.0, None] + [0.0] * 10, 0), (2060, [0.0] * 12, 0), (None, points[0].tolist(), 0)]
    return rows


def usable(zero):
    good = [(i, np.array(v, float)) for i, v, _ in vectors() if i is not None and v and None not in v and np.isfinite(v).all()]
    return [(i, v) for i, v in good if zero or v.any()]


def answers(found, k):
    ids, points = np.array([i for i, _ in found]), np.stack([v for _, v in found])
    out = {}
    for at in np.flatnonzero(ids % 20 == 0):
        scores = (points * points[at]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if j != at][:k]
        out[int(ids[at])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), "vec_id bigint, embedding array<float>, cell int").repartition(5).cache()


def grouped(df):
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert row.rank == len(out.setdefault(row.query_id, [])) + 1
        out[row.query_id].append((row.vec_id, float(row.score)))
    return out


def test_join_is_exact(table, spark):
    expected = answers([(i, np.floor(64 * v)) for i, v in usable(zero=True)], 20)
    assert grouped(knnjoin.search(table, most_sample=64, most_pivots=16)) == expected
    assert knnjoin.search(table.limit(0)).count() == 0
    few = table.where("vec_id IN (0, 1, 2)")
    assert {q: len(a) for q, a in grouped(knnjoin.search(few)).items()} == {0: 2}


def test_tree_reaches_its_recall(table):
    expected = answers(usable(zero=False), 20)
    made = grouped(kmtree.search(table))
    assert made.keys() == expected.keys() and all(len(a) == 20 for a in made.values())
    assert np.mean([len({i for i, _ in made[q]} & {i for i, _ in a}) / len(a) for q, a in expected.items()]) >= 0.9
    exact = {i: v for i, v in usable(zero=False)}
    assert all(score == pytest.approx(float(exact[q] @ exact[i]), rel=1e-12) for q, a in made.items() for i, score in a)
    assert kmtree.search(table.limit(0)).count() == 0


def test_walk_is_best_bin_first():
    points = np.random.default_rng(0).normal(size=(2000, 6))
    tree = kmtree.Tree(points, 6, 40)
    query = points[5]
    order = tree.walk(query, tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.walk(query, 3) == order[:3]
    assert sorted(np.unique(tree.assign(points)).tolist()) == sorted(set(tree.assign(points).tolist()))


URLS = [
    "https://A.Example.com/en/1?x=1", "http://www.example.com/en/2#t", "https://example.com/de/3", "https://x.net/es/4/", "https://x.net/fr/5",
    "https://x.net/de/6", "https://com", "https://com/", "nohost", "", None, "ftp://h.org", "https://h.org?x=/en/", "https://com.org/en/1", "://",
    "https://É.Net/es/1",
]


def plain(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h) + len(p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, salt int")
    made = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert made == {i: plain(u) for i, u in enumerate(URLS)}
    assert urls.judge(pages.limit(0)).count() == 0
    twice = urls.judge(pages.union(pages)).collect()
    assert len(twice) == 2 * len(URLS)


def test_templates_are_rejected_by_their_labels(spark):
    rows = [("h.org", f"/shop/item{i}/view", 1 if i < 20 else None) for i in range(60)]
    rows += [("h.org", f"/news/{i}", 0 if i < 20 else None) for i in range(60)]
    rows += [("h.org", f"/rare/{i}", 1 if i < 2 else None) for i in range(5)]
    made = spark.createDataFrame(rows, "host string, path string, bad bigint")
    tree = urls.templates(made.select("host", urls.segments(made.path).alias("shapes"), "bad"))
    verdict = {(r.template, r.rejected) for r in tree.collect()}
    assert ("/shop/*/view/<end>", True) in verdict
    assert {r for t, r in verdict if t.startswith(("/news", "/rare"))} == {False}


def test_urls_without_rule_go_with_their_branch(spark):
    """On `pages`: where most of a host is blocked by rules its other urls are too; hosts without rules stay."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    made = urls.judge(pages).collect()
    of_host = {}
    for row in made:
        own = of_host.setdefault(row.host, {"block": 0, "allow": 0, "free": []})
        if row.rule:
            own[row.verdict] += 1
        else:
            own["free"].append(row.verdict)
    blocked = [v for own in of_host.values() for v in own["free"] if own["block"] >= 20 and not own["allow"]]
    clean = [v for own in of_host.values() for v in own["free"] if own["allow"] >= own["block"]]
    assert blocked and set(blocked) == {"block"}
    assert clean and set(clean) == {"allow"}


def test_purity_flows_down_and_deep_paths_count(spark):
    rows = [("a.org", f"/x/{i}", 1) for i in range(30)] + [("a.org", f"/y/{i}", None) for i in range(5)]
    rows += [("b.org", f"/x/{i}", 0) for i in range(30)] + [("b.org", f"/y/{i}", None) for i in range(5)]
    deep = "/p/q/r/s"
    rows += [("c.org", f"{deep}/bad/t{i % 3}/u", 1) for i in range(30)] + [("c.org", f"{deep}/good/v", 0) for i in range(30)]
    made = spark.createDataFrame(rows, "host string, path string, bad bigint")
    tree = urls.templates(made.select("host", urls.segments(made.path).alias("shapes"), "bad")).collect()
    found = {(r.host, r.shapes[0], r.shapes[-2]): r.rejected for r in tree}
    assert found["a.org", "x", "<n>"] and found["a.org", "y", "<n>"]
    assert not found["b.org", "x", "<n>"] and not found["b.org", "y", "<n>"]
    assert {r for (h, _, last), r in found.items() if h == "c.org" and last.startswith("bad/")} == {True}
    assert {r for (h, _, last), r in found.items() if h == "c.org" and last.startswith("good/")} == {False}


def test_alike_branches_merge(spark):
    rows = [("h.org", f"/{branch}/{i}", i % 2) for branch in ("aa", "bb") for i in range(40)]
    rows += [("h.org", f"/cc/{i}", 1) for i in range(40)]
    made = spark.createDataFrame(rows, "host string, path string, bad bigint")
    tree = urls.templates(made.select("host", urls.segments(made.path).alias("shapes"), "bad")).collect()
    by_shape = {r.shapes[0]: r.template for r in tree}
    assert by_shape["aa"] == by_shape["bb"] != by_shape["cc"]
