"""The whole pipeline against one written by hand, and its stages on odd input."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from prismora.llm import quality_fm, source_mixing
from pyspark.sql import functions as F

from .common import empty, odd
from .test_lines_packing_mixing import bins_by_hand


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    words = [f"word{i}" for i in range(900)]
    rows = []
    for i in range(90):
        rows.append([i, "\n".join(" ".join(r.choice(words) for _ in range(r.randint(3, 14))) + "." for _ in range(r.randint(1, 7)))])
    lines = [x for _, t in rows for x in t.split("\n")]
    for i in range(90, 150):
        base = r.choice(rows)[1].split("\n")
        if i % 3 == 0:  # lines of others between own ones
            base = [x for y in base for x in (y, r.choice(lines), "", f"own line {i} {r.random()}")]
        elif i % 3 == 1:  # near copies with other line ends
            w = " ".join(base).split(" ")
            w[r.randrange(len(w))] = f"new{i}"
            base = [" ".join(w)]
        rows.append([i, "\n".join(base)])
    rows += [[200 + i, " ".join(f"{r.choice(words)}%%%" for _ in range(40))] for i in range(30)]
    rows += [[400, None], [401, ""], [402, " \n "], [None, "no id here at all"], [5, "another text of five words more"]]
    d = str(tmp_path_factory.mktemp("hand"))
    full = [(i, t, "en" if k % 5 else None, f"s{k % 3}" if k % 7 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def lines_by_hand(docs, hashes):
    """First occurrences of lines by document, text hash and place."""
    seen, out = set(), []
    once = {(i, t): row for row in docs for i, t in [row[:2]]}
    kept = {}
    for i, t in sorted(once, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]])):
        mine = []
        for x in (t or "").split("\n"):
            if not x.strip() or x not in seen:
                mine.append(x)
                if x.strip():
                    seen.add(x)
        kept[i, t] = mine
    for (i, t), row in once.items():
        whole = (t or "").split("\n")
        if t is None or kept[i, t] == whole:
            out.append(row)
        elif any(x.strip() for x in kept[i, t]):
            text = "\n".join(kept[i, t])
            out.append((i, text, *row[2:4], len(text)))
    return out


def near_copies_by_hand(docs):
    sets = {}
    for k, (i, t, *_) in enumerate(docs):
        w = (t or "").lower().split()
        if i is not None and w:
            sets[k] = frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2)))
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in sets:
        groups[find(k)].append(k)
    gone = {k for g in groups.values() for k in g if docs[k][0] != min(docs[j][0] for j in g)}
    return [row for k, row in enumerate(docs) if k not in gone]


def mixed_by_hand(docs, weight):
    """Copies of each row by the definition: budgets, complete epochs, then rising keys to the rest."""
    tokens = [len((t or "").split()) for _, t, *_ in docs]
    total = Counter()
    for (_, _, _, source, _), n in zip(docs, tokens):
        total[source] += n
    total = {s: n for s, n in total.items() if n}
    most = max(n / n**0.7 for n in total.values())
    out = []
    for s, n in total.items():
        epochs, rest = divmod(math.floor(most * n**0.7 + 0.5), n)
        u = lambda i: (int(hashlib.md5(f"0|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1)
        mine = sorted((-math.log(u(row[0])) / max(0.01, weight[row[0], row[1]]), row[0] is not None, row[0] or 0, k) for k, row in enumerate(docs) if row[3] == s and tokens[k])
        running = 0
        for *_, k in mine:
            running += tokens[k]
            out += [docs[k]] * (epochs + (running <= rest))
    return out


def test_run_equals_the_pipeline_by_hand(spark, tables):
    import corpus_pipeline as C

    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    model = quality_fm.train(docs, labels)
    verdict = quality_fm.classify(docs.withColumn("k", F.struct("doc_id", "text")), model, id_col="k").collect()
    kept = {(r["doc_id"]["doc_id"], r["doc_id"]["text"]) for r in verdict if r["keep"]}
    rows = [tuple(r) for r in docs.collect()]
    stage = [r for r in rows if r[:2] in kept]
    assert 60 < len(stage) < len(rows)
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    stages = [stage, lines_by_hand(stage, hashes)]
    stages.append(near_copies_by_hand(stages[-1]))
    assert len({len(s) for s in stages}) == 3
    df = spark.createDataFrame(stages[-1], docs.schema)
    weight = {(r["doc_id"], r["text"]): r["w"] for r in quality_fm.with_quality(df, model, "w").collect()}
    stages.append(mixed_by_hand(stages[-1], weight))
    got = docs
    for (_, f), want in zip(C.STAGES, stages):
        got = C.written(f(spark, got, tables), "by-hand")
        assert Counter(map(tuple, got.collect())) == Counter(want)
    pieces = C.run(spark, tables).collect()
    tokens = Counter()
    for r in pieces:
        tokens[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, t, *_ in stages[-1]:
        want[i] += len(t.split())
    assert tokens == want
    slots = [(r["bin_id"], r["bin_offset"] + k) for r in pieces for k in range(r["n_tokens"])]
    assert len(slots) == len(set(slots)) and len({r["bin_id"] for r in pieces}) == len(bins_by_hand([r["n_tokens"] for r in pieces], 2048))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_input(spark, tables, k):
    """Nulls in all columns, empty and very long texts, repeated rows, clashing names, an empty table."""
    import corpus_pipeline as C

    name, stage = C.STAGES[k]
    docs = odd(spark)
    got = stage(spark, docs, tables)
    rows = got.collect()
    if name == "best_fit_packing":
        assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 6) == 30_000 and len([r for r in rows if r["doc_id"] == 7]) == 2
    else:
        assert got.columns == docs.columns and all(r["keep"] == "extra" for r in rows)
        ids = Counter(r["doc_id"] for r in rows)
        assert name == "quality_classifier" or ids[6] >= 1
        assert name not in ("line_dedup", "ngram_jaccard_join") or ids[7] == 1
        assert name != "source_mixing" or not ids[3] + ids[4] + ids[5]
    assert stage(spark, empty(spark), tables).count() == 0


def test_scores_of_rows_are_those_of_the_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = quality_fm.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    a = quality_fm.with_quality(docs, model, "w").select("doc_id", "w").where("doc_id is not null and doc_id <> 5")
    b = quality_fm.classify(docs, model).select("doc_id", (F.col("quality") * (1 - F.col("toxicity"))).alias("v"))
    assert a.join(b, "doc_id").where("abs(w - v) > 1e-9").count() == 0 and a.where("w between 0 and 1").count() == a.count()
    assert source_mixing.LEAST_WEIGHT == 0.01
