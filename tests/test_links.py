"""Title links against all pairs."""

import random

from prismora.operators import linkage as L


def by_hand(left, right):
    out = {}
    for l, lt in left:
        found = []
        for r, rt in right:
            x, y = lt.split(), rt.split()
            j = len({*x} & {*y}) / len({*x} | {*y})
            if lt == rt:
                found.append((0, -j, r))
            elif len(x) >= 6 and rt.startswith(lt + " ") or len(y) >= 6 and lt.startswith(rt + " "):
                found.append((1, -j, r))
            elif j >= 0.75:
                found.append((2, -j, r))
        if found:
            k, j, r = min(found)
            out[l] = (r, ("exact", "prefix", "fuzzy")[k], round(-j, 9))
    return out


def linked(spark, left, right):
    a, b = spark.createDataFrame(left, "l bigint, t string"), spark.createDataFrame(right, "r bigint, u string")
    return {x["l"]: (x["r"], x["how"], round(x["score"], 9)) for x in L.title_links(a, b, "l", "t", "r", "u").collect()}


def test_rare_words_that_the_partner_lacks(spark):
    """The left titles' four rarest words are all missing from the right title that matches."""
    head = "one two three four five six"
    common = " ".join(f"w{i}" for i in range(16))
    rare = "ra rb rc rd"
    left = [(1, f"{head} {rare}"), (2, f"{rare} {common}")]
    right = [(10, head), (11, common), (12, f"{rare} x y z"), *[(20 + i, f"{head} w{i} w{i + 1} w{i + 2} other{i}") for i in range(14)]]
    got = linked(spark, left, right)
    assert got == by_hand(left, right)
    assert got[1][:2] == (10, "prefix") and got[2][:2] == (11, "fuzzy")


def test_links_equal_all_pairs(spark):
    r = random.Random(7)
    names = [f"n{i}" for i in range(40)]
    stems = [[r.choice(names) for _ in range(r.randint(1, 24))] for _ in range(25)]

    def title():
        s = list(r.choice(stems))
        for _ in range(r.randint(0, max(1, len(s) // 3))):
            s[r.randrange(len(s))] = r.choice([*names, "fresh"])
        return " ".join(s[: r.choice([len(s), len(s), 6, 8])] + [r.choice(names) for _ in range(r.choice([0, 0, 3]))])

    left, right = [(i, title()) for i in range(150)], [(i, title()) for i in range(300)]
    expected = by_hand(left, right)
    assert {how for _, how, _ in expected.values()} == {"exact", "prefix", "fuzzy"}
    assert linked(spark, left, right) == expected


def test_twenty_words_with_the_rarest_missing(spark):
    """Titles of 20 words at Jaccard 0.762: the words they share are not among the four rarest."""
    own, common = [f"own{i}" for i in range(4)], [f"c{i}" for i in range(16)]
    left, right = [(1, " ".join(own[:3] + common + ["x"]))], [(10, " ".join(common + ["x", "y", "z"][:1]))]
    right += [(20 + i, " ".join(common[: i + 1])) for i in range(12)]
    assert linked(spark, left, right) == by_hand(left, right) and by_hand(left, right)[1][1] == "fuzzy"


def test_containment_equals_all_pairs(spark):
    r = random.Random(11)
    names = [f"n{i}" for i in range(60)]
    text = lambda lo, hi: " ".join(r.choice(names[:20] if r.random() < 0.7 else names) for _ in range(r.randint(lo, hi)))
    items, docs = [(i, text(1, 12)) for i in range(40)] + [(98, ""), (99, None)], [(i, text(0, 60)) for i in range(200)] + [(900, None)]
    for least in (0.4, 0.7, 1.0):
        want = {}
        for i, a in items:
            for k, b in docs:
                x, y = {*(a or "").split()}, {*(b or "").split()}
                if x and len(x & y) / len(x) >= least:
                    want[i, k] = len(x & y)
        a, b = spark.createDataFrame(items, "i int, a string"), spark.createDataFrame(docs, "k int, b string")
        assert {(x["i"], x["k"]): x["shared"] for x in L.containment(a, "i", "a", b, "k", "b", least).collect()} == want


def test_containment_broadcasts_no_document_words(spark):
    """The table of document words is small as a file, but not in memory: no plan sends it to the driver."""
    items = spark.createDataFrame([(i, " ".join(f"n{k}" for k in range(i, i + 9))) for i in range(20)], "i int, a string")
    docs = spark.range(3000).selectExpr("cast(id as int) as k", "array_join(transform(sequence(0, 29), x -> concat('n', pmod(id * 7 + x, 40))), ' ') as b")
    got = L.containment(items, "i", "a", docs, "k", "b", 0.7)
    lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i in [k for k, x in enumerate(lines) if "BroadcastExchange" in x]:
        below = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
        tree = "\n".join(lines[i + 1 : below])
        assert "item-words" not in tree or "HashAggregate" in tree  # their counts by word may travel
    assert got.count() > 0
