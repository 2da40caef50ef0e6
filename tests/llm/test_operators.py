"""Each operator against SQL or brute force, and on awkward and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bwt, components, decontamination, fmindex, jaccard, mixing, outliers, quality, queries, sample, secrets, sharding, store, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, same_as_sql, folder, name):
    same_as_sql(queries.QUERIES[name](spark, folder), queries.SQL[name], folder)


# -- 1 ------------------------------------------------------------------------------------------


def test_secret_rules():
    assert secrets.scan_text('API_key = "abc-123" tokens secret:short Secret=longer') == [("assign", 0, 18), ("assign", 40, 53)]
    assert secrets.scan_text("AKIA" + "A" * 16 + " " + "0" * 24) == [("access", 0, 20), ("hex", 21, 45)]
    assert secrets.scan_text("é" * 3 + " token:" + "z" * 6) == [("assign", 4, 16)]
    assert secrets.scan_text(None) == secrets.scan_text("") == []


def test_ledger_scans_unseen_pairs_only(spark, awkward):
    ledger = store.new_path(spark, "t-ledger")
    first = secrets.scan_versions(awkward, "doc_id", "text", ledger).collect()
    n = secrets.read_ledger(spark, ledger).count()
    assert n == awkward.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = secrets.scan_versions(awkward, "doc_id", "text", ledger).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == awkward.count()
    assert secrets.read_ledger(spark, ledger).count() == n
    secrets.scan_versions(awkward.limit(3), "doc_id", "text", ledger, rule_version=2)
    assert secrets.read_ledger(spark, ledger).where("rule_version = 2").count() == 2  # null and empty are one blob


# -- 2 ------------------------------------------------------------------------------------------


def stats(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, cover, dup, lines = Counter(grams), set(), 0, set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover |= set(range(i, i + 5))
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_counts_by_brute_force(spark, awkward):
    docs = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(awkward.collect())] + [(99, "a b c d e f\na b c d e f\n\na b\n# $")], "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    want = {r["doc_id"]: stats(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: tuple(r[c] for c in outliers.COUNTS[:5]) for r in outliers.counts(docs).collect()}
    assert got == want


def test_outliers_keep_clean_and_drop_junk(spark, folder):
    out = outliers.reject_outliers(spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")).join(spark.read.parquet(folder.replace("0.001", "0.01") + "/labels.parquet"), "doc_id")
    clean = out.where("quality = 1 and not base_failed")
    assert clean.where("not kept").count() <= 0.01 * clean.count()
    junk = out.where("quality = 0")
    assert junk.where("kept").count() <= 0.1 * junk.count()


def brute_estimate(x, centre, scatter):
    """The estimate of one group by whole subsets of sorted distances."""
    n = len(x)
    low, median, high = (np.quantile(x, q, axis=0) for q in (0.25, 0.5, 0.75))
    sd = np.maximum((high - low) / 1.349, outliers.FLOOR)
    z = (x - median) / sd
    clipped = median + sd * np.clip(z, -outliers.CLIP, outliers.CLIP)
    u = z / np.sqrt((z * z).sum(1) + 1e-12)[:, None]
    best = (np.inf, None)
    for cov in outliers.starts(sd[None], np.cov(clipped.T, bias=True)[None], (u.T @ u / n)[None]):
        mean, cov = outliers.steadied([n], median[None], cov, centre[None], scatter[None])
        for _ in range(outliers.STEPS):
            d = x - mean[0]
            near = np.argsort((d @ np.linalg.inv(cov[0]) * d).sum(1), kind="stable")[: outliers.half(n)]
            mean, cov = outliers.concentrated([n], [len(near)], x[near].sum(0)[None], (x[near].T @ x[near])[None], centre[None], scatter[None])
            best = min(best, (np.linalg.slogdet(cov[0])[1], mean[0], cov[0]), key=lambda b: b[0])
    return best[1:]


def test_kept_by_brute_force(spark, folder):
    """Against estimates over whole subsets: bins of distance may take a hundredth more, so few rows near the cut differ."""
    docs = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet").withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    stats = outliers.grouped(outliers.counts(docs)).select("doc_id", "grp", "language", "n_words", "n_repeat_words", *outliers._vector()).toPandas()
    got = {r["doc_id"]: r["kept"] for r in outliers.reject_outliers(docs).collect()}
    fits = stats[~((stats.n_words < 10) | (100 * stats.n_repeat_words > 20 * stats.n_words))]
    rows = lambda t: t[outliers.NAMES].to_numpy(float)
    low, median, high = (np.quantile(rows(fits), q, axis=0) for q in (0.25, 0.5, 0.75))
    usual = np.maximum((high - low) / 1.349, outliers.FLOOR)
    languages = {k: brute_estimate(rows(t), median, np.diag(usual**2)) for k, t in fits.groupby("language")}
    differ = 0
    for _, group in fits.groupby("grp"):
        x = rows(group)
        mean, cov = brute_estimate(x, *languages[group.language.iloc[0]])
        want = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1) <= outliers.chi2_quantile(outliers.CUT, outliers.P)
        differ += sum(got[i] != k for i, k in zip(group.doc_id, want, strict=True))
    assert differ <= 0.005 * len(fits) and not any(got[i] for i in set(stats.doc_id) - set(fits.doc_id))


def test_planted_outliers_go_from_groups_of_any_size(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in enumerate((3, 12, 400)):
        for i in range(n):
            rows.append((len(rows), " ".join("".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(int(rng.integers(80, 300)))), "en", f"s{k}"))
    bad = len(rows)
    rows += [(bad + k, " ".join(f"{'#$%'[k]}{i}|<>" * 30 for i in range(200)), "en", f"s{k}") for k in range(3)]
    out = {r["doc_id"]: r for r in outliers.reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [out[bad + k]["kept"] for k in range(3)] == [False] * 3 and sum(not out[i]["kept"] for i in range(bad)) <= 2


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_texts_that_collide_in_a_plain_polynomial(spark):
    """Two different words, and two different lines, of 1,024 letters."""
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    tail = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one}\n{two}"), (4, f"{one} {tail}"), (5, f"{two} {tail}")], "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    assert {r["doc_id"]: r["n_dup_lines"] for r in outliers.counts(docs).collect()}[3] == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute_components(rows)
    assert all(r["starts"] == [] for r in substrings.dedup_words(docs).collect())


def test_outliers_on_awkward(spark, awkward, nothing):
    assert outliers.reject_outliers(awkward).count() == awkward.count()
    assert outliers.reject_outliers(nothing).count() == 0


# -- 3 ------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard_by_brute_force(spark, awkward):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 400, 60)]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for i in range(100, 180):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, 60))] = f"n{i}"
        rows.append((i, " ".join(w[: int(rng.integers(30, 60))] if i % 3 else w).upper() if i % 2 else " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute_components(rows)


def test_lone_pairs_that_differ_in_the_last_word(spark):
    """Many keep size and prefix, so the two are one group; no other document shares a shingle with them."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(int(rng.integers(12, 120)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
    rows += [(500, " ".join(f"q{i}" for i in range(40))), (500, " ".join([*(f"q{i}" for i in range(39)), "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute_components(rows)


def shuffled_by_table(spark, monkeypatch):
    """Bytes that were shuffled to write each table of jaccard, filled as they are written."""
    out, written, store_of = Counter(), store.written, spark.sparkContext._jsc.sc().statusStore

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        arrays = spark.sparkContext._gateway.new_array
        stages = store_of().stageList(None, False, False, arrays(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def counted(df, name):
        before = total()
        table = written(df, name)
        out[name] += total() - before
        return table

    monkeypatch.setattr(jaccard.store, "written", counted)
    return out


def test_only_texts_of_candidates_are_shuffled_for_sets(spark, monkeypatch):
    """As on large tables, where the candidates are too many to be sent to all tasks."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"{x:012x}" for x in rng.integers(0, 1 << 48, 200))) for i in range(300)]
    rows += [(1000, f"{rows[7][1]} more"), (None, f"{rows[8][1]} more")]
    docs = store.written(spark.createDataFrame(rows, "doc_id long, text string"), "t-docs")
    by = shuffled_by_table(spark, monkeypatch)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == brute_components(rows)
    size = sum(len(t) for _, t in rows)
    assert by["members"] > size / 2 and 0 < by["sets"] < size / 10, (size, by)


def test_sets_outside_the_pairs_are_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(12)
    sets = [(i, np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64)).tobytes()) for i in range(200)]
    sets += [(1000, sets[7][1]), (1001, sets[8][1][: 8 * 800]), (1002, sets[9][1][: 8 * 700])]
    sets = store.written(spark.createDataFrame(sets, "cid long, items binary"), "t-sets")
    near = store.written(spark.createDataFrame([(7, 1000), (8, 1001), (9, 1002)], "a long, b long"), "t-near")
    by = shuffled_by_table(spark, monkeypatch)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sorted(tuple(r) for r in jaccard.verified(near, sets, "t").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found == [(7, 1000), (8, 1001)]
    assert 0 < by["t-links"] < 200 * 8000 / 4, by


def test_shingles_of_one_group_are_not_posted(spark, monkeypatch):
    """Copies share their shingles with each other only; near copies, also of one group, still meet."""
    rng = np.random.default_rng(13)
    texts = [" ".join(f"{x:08x}" for x in rng.integers(0, 1 << 32, 60)) for _ in range(8)]
    rows = [(10 * i + j, t) for i, t in enumerate(texts) for j in range(4)]
    rows += [(500, f"{texts[6]} more"), (None, f"{texts[7]} more")]
    posted, written = [], store.written
    monkeypatch.setattr(jaccard, "SLICE", 2000)  # copies are in different slices
    monkeypatch.setattr(jaccard.store, "written", lambda df, name: posted.append((name, written(df, name))) or posted[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute_components(rows)
    groups = dict(posted)["postings"].groupBy("token").agg(F.countDistinct("grp").alias("n"))
    assert groups.count() > 0 and groups.where("n < 2").count() == 0


def test_release_trims_the_native_heap_of_the_driver(spark, monkeypatch):
    assert store.trim(spark)  # this JVM can
    done, trim = [], store.trim
    monkeypatch.setattr(store, "trim", lambda s: done.append(trim(s)))
    store.release(spark)
    assert done == [True]


def test_sieve_loses_no_row(spark, monkeypatch):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("a"), F.xxhash64("id").alias("b"))
    wanted = rows.where("b % 10 = 0 or a is null").select(F.col("a").alias("x"), F.col("b").alias("y"))
    n = wanted.count()
    for tables in (jaccard.TABLES, 1):
        monkeypatch.setattr(jaccard, "TABLES", tables)
        left = jaccard.sifted(rows, wanted, ["a", "b"], ["x", "y"])
        assert left.columns == rows.columns
        same = F.col("a").eqNullSafe(F.col("x")) & (F.col("b") == F.col("y"))
        assert left.join(wanted, same, "left_semi").count() == n <= left.count() < n + 5000 * n * (3 if tables > 1 else 50) // 32768 + 200
    assert jaccard.sifted(rows, wanted.limit(0), ["a", "b"], ["x", "y"]).count() == 0


def test_one_of_each(spark, awkward, nothing):
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum(t is None or not t.strip() for t in texts) == 3  # no words: they stay
    assert len([t for t in texts if t and t.startswith("alpha")]) == 1  # the long one goes round, and so shares 15 of 19 shingles
    assert jaccard.near_duplicates(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["u"]: r["m"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


# -- 4 ------------------------------------------------------------------------------------------


def test_targets_by_filling(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 30), ("d", 500), (None, 7), ("e", 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    order = sorted((s for s, _ in sizes if s), key=str) + [None]
    size, weight = dict(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left, total = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and left * weight[s] / total > 2 * size[s]}
        if not new:
            break
        full |= new
    for s in order:
        assert got[s] == pytest.approx(2 * size[s] if s in full else left * weight[s] / total)


def test_rows_without_ids_are_drawn_apart(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("a b c "), F.col("id").cast("string"))).otherwise(F.lit("one two three four")).alias("text"), F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("string")).alias("source"))
    plan = mixing.plan(docs).withColumn("taken", F.col("size") * F.col("copies")).groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(plan) == 4 and all(abs(r["taken"] / r["target"] - 1) < 0.1 for r in plan)
    assert sum(r["target"] for r in plan) == pytest.approx(1.5 * 12000)
    assert sorted(map(str, mixing.plan(docs.repartition(7)).drop("doc_id").collect())) == sorted(map(str, mixing.plan(docs).drop("doc_id").collect()))


def test_mix_agrees_with_plan(spark, awkward, nothing):
    plan = Counter()
    for r in mixing.plan(awkward).collect():
        assert r["copies"] <= 2
        plan[r["doc_id"]] += r["copies"]
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns and Counter(r["doc_id"] for r in mixed.collect()) == +plan
    assert mixing.plan(nothing).count() == mixing.mix(nothing).count() == 0


# -- 5 and 7 ------------------------------------------------------------------------------------


def test_bwt_by_sorting():
    rng = np.random.default_rng(5)
    for t in range(20):
        strings = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(6)]
        begin = np.cumsum([len(s) for s in strings]) - [len(s) for s in strings]
        b, common, place = bwt.collection_bwt(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), memory=0 if t % 2 else 1 << 20)
        want = sorted(([*s[o:], -100 + i], begin[i] + o, s[o - 1] if o else -1) for i, s in enumerate(strings) for o in range(len(s)))
        assert place.tolist() == [p for _, p, _ in want] and b.tolist() == [x for _, _, x in want]
        for k in range(1, len(want)):
            n = 0
            while want[k - 1][0][n] == want[k][0][n]:
                n += 1
            assert common[k] == n


def test_rank_of_the_wavelet_matrix():
    x = np.random.default_rng(1).integers(0, 11, 300)
    w = fmindex.WaveletMatrix(x, 11)
    for c in range(11):
        at = np.arange(301)
        assert (w.rank(np.full(301, c), at) == np.concatenate([[0], np.cumsum(x == c)])).all()


def brute_bytes(rows, window):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if b[p : p + window] in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(b[p : p + window])
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d, len(b), [a for a, _ in runs], [e for _, e in runs], hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1024, 1])
def test_suffix_dedup_by_brute_force(spark, hot):
    rng = np.random.default_rng(7)
    chunk = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = chunk(150)
    rows = [(1, None), (2, ""), (3, "a" * 400), (4, shared[:99]), (5, chunk(80) + shared + chunk(30)), (6, shared), (7, shared * 2), (8, "ab" * 120)]
    rows += [(i, chunk(20) + shared[: int(rng.integers(90, 150))] + chunk(40)) for i in range(10, 40)] + [(50, "z" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_symbols"], r["starts"], r["ends"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in substrings.dedup_bytes(docs, replace(substrings.SUFFIXES, hot=hot)).collect()]
    assert sorted(got) == sorted(brute_bytes(rows, 100))


def test_suffix_dedup_of_rows_with_one_id(spark):
    """What is kept of null ids, and of rows with one id: as many bytes as if they followed each other in one document's place."""
    rng = np.random.default_rng(9)
    shared = "".join(rng.choice(list("abcdef "), 130))
    rows = [(None, shared + "x"), (None, shared + "x"), (None, "y" + shared), (4, shared), (4, shared), (5, "no " * 20)]
    out = substrings.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = sum(b - a for r in out for a, b in zip(r["starts"], r["ends"], strict=True))
    assert len(out) == len(rows) and gone in (130 * 4 + 1, 130 * 4 + 31) and all(r["starts"] == [0] for r in out if r["doc_id"] == 4)


@pytest.mark.parametrize("hot", [1024, 1])
def test_word_dedup_by_brute_force(spark, hot):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(rng.choice(["a", "b", "c", "dd", "é"], n))
    shared = words(30)
    rows = [(None, shared), (1, None), (2, ""), (3, shared), (3, shared + " x"), (4, words(5) + "\n" + shared), (None, words(9) + " " + shared)]
    rows += [(i, words(8) + " " + " ".join(shared.split()[: int(rng.integers(10, 30))]) + " " + words(12)) for i in range(10, 50)]
    low: dict = {}
    key = lambda d: -1 if d is None else d
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            low[tuple(w[i : i + 13])] = min(low.get(tuple(w[i : i + 13]), key(d)), key(d))
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < key(d) for j in range(i, i + 13)}
        want.append((key(d), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(key(r["doc_id"]), r["n_symbols"], sum(r["ends"]) - sum(r["starts"]), bytes(r["kept"]).decode()) for r in substrings.dedup_words(docs, replace(substrings.PASSAGES, hot=hot)).collect()]
    assert sorted(got) == sorted(want)


def test_dedup_on_awkward(spark, awkward, nothing):
    for f in (substrings.dedup_bytes, substrings.dedup_words):
        assert f(awkward).count() == awkward.count() and f(nothing).count() == 0


# -- 6 and 8 ------------------------------------------------------------------------------------


def test_toxicity_is_learned(spark, folder):
    folder = folder.replace("0.001", "0.1")
    out = toxicity.op6_toxicity_cnn(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(out.doc_id, out.held_out, strict=True))
    held = out[out.held_out]
    rank = held.score.rank()
    pos = held.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    assert auc > 0.9 and held[pos].predicted.mean() > 0.8 and held[~pos].predicted.mean() < 0.05


def test_quality_is_learned(spark, folder):
    folder = folder.replace("0.001", "0.01")
    out = quality.op8_ordinal_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.98 and out[out.quality == 0].kept.mean() < 0.05


def test_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(300, 20))).astype(np.float32)
    y = np.digitize(x[:, 0] - x[:, 1], [-0.5, 0.5])
    m = quality.fit(x, y)
    assert m.grades == [0, 1, 2] and (np.diff(m.thresholds) > 0).all()
    grade, tail = m.judge(x @ m.weights)
    assert np.corrcoef(grade, y)[0, 1] > 0.8 and ((tail >= 0) & (tail <= 1)).all()


def test_too_many_label_values_are_an_error(spark):
    labels = spark.createDataFrame([(i, i) for i in range(sample.VALUES + 1)], "doc_id long, grade int")
    assert len(sample.labelled(labels.limit(sample.VALUES), "grade", 5)) == sample.VALUES
    with pytest.raises(ValueError, match="64 values"):
        sample.labelled(labels, "grade", 5)


def test_one_text_of_a_labelled_id_is_fitted_on(spark):
    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text")).unionByName(spark.createDataFrame([(2, "other words"), (3, None)], "doc_id long, text string"))
    got = sample.features(docs, {1: 0, 2: 1, 3: 1}, lambda b: toxicity._ids(b, "doc_id", "text"))
    assert [i for i, _ in got] == [1, 2, 3] and got == sample.features(docs.repartition(5), {1: 0, 2: 1, 3: 1}, lambda b: toxicity._ids(b, "doc_id", "text"))
    ids = np.arange(3 * 100_000).reshape(3, -1)
    some = toxicity._spread(ids)
    assert some.shape == (3, toxicity.FIT_WORDS) and some[0, 0] == 0 and some[0, -1] == 99_999 and (np.diff(some[0]) > 0).all()


def test_line_is_weights_times_vector():
    import pyarrow as pa

    from quire.llm import text as X

    texts = ["A short text, of some words.", "", "## 99 ## aa aa aa", "é" * 300, "the same line\n" * 50]
    buf, off = X.utf8(pa.array(texts))
    m = quality.Model(np.random.default_rng(0).normal(size=quality.SIZE), np.array([0.0]), [0, 1], usual_bytes=0)
    some = np.diff(off) > 0
    with np.errstate(invalid="ignore"):
        line = m.line(buf, off)
    assert np.allclose(line[some], (quality.vectors(buf, off) @ m.weights)[some], rtol=1e-4, atol=1e-4)


def test_responses_by_brute_force():
    rng = np.random.default_rng(0)
    offsets = sum(toxicity.WIDTHS)
    net = toxicity.Net(rng.normal(size=(3, toxicity.BUCKETS, toxicity.DIM)), rng.normal(size=(toxicity.DIM, offsets, toxicity.FILTERS)), rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS), rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS), 0.3)
    lengths = [0, 1, 2, 7]
    ids = rng.integers(0, toxicity.BUCKETS, (3, sum(lengths)))
    first = np.concatenate([[0], np.cumsum(lengths)])
    got = net.logits(ids, first, net.tables())
    for t, n in enumerate(lengths):
        x = sum(net.embed[k][ids[k, first[t] : first[t + 1]]] for k in range(3)).reshape(n, toxicity.DIM)
        pooled, o = np.zeros((len(toxicity.WIDTHS), toxicity.FILTERS)), 0
        for k, w in enumerate(toxicity.WIDTHS):
            if n:
                pooled[k] = np.max([sum(x[i + j] @ net.conv[:, o + j] for j in range(w) if i + j < n) for i in range(n)], axis=0)
            o += w
        assert got[t] == pytest.approx(np.maximum(pooled.ravel() + net.bias, 0) @ net.out + net.base, rel=1e-3, abs=1e-3)


def test_classifiers_on_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (awkward, nothing):
        for lab in (labels, labels.limit(0)):
            assert toxicity.scored(docs, toxicity.train(docs, lab, most=5)).count() == docs.count()
            assert quality.judged(docs, quality.train(docs, lab)).count() == docs.count()


# -- 9 ------------------------------------------------------------------------------------------


def test_shards_fit_and_split_only_where_needed(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    out = sharding.shard(docs, limit=2000).toPandas()
    size = out.assign(n=out.text.str.len()).groupby("shard_id").n.sum()
    assert len(out) == 2000 and (size <= 2000).all()
    for s in size.index:  # the bucket one bit shorter would not have fitted
        depth, bits = int(s[:2]), int(s[3:], 16)
        kin = [k for k in size.index if int(k[:2]) >= depth and int(k[3:], 16) >> (int(k[:2]) - depth + 1) == bits >> 1]
        assert size[kin].sum() > 2000


def test_one_giant_and_few_small(spark):
    rows = spark.createDataFrame([(i, 10**14 if i == 3 else 100) for i in range(7)], "doc_id long, __quire_bytes long").withColumn("__quire_hash", sharding.hash_bits(F.col("doc_id")))
    out = sharding.assign(rows, 1 << 20).collect()
    assert len(out) == 7 and [r["doc_id"] for r in out if r["oversize"]] == [3]
    assert all(r["shard_bytes"] <= 1 << 20 for r in out if not r["oversize"])


def test_hot_ids_are_paged(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("y" * 10).alias("text"), F.lit(1).alias("__hash2"))
    out = sharding.shard(docs, limit=500)
    size = out.groupBy("shard_id").agg(F.sum(F.length("text")).alias("n"))
    assert out.count() == 3000 and size.agg(F.max("n")).first()[0] <= 500


def test_shards_on_awkward(spark, awkward, nothing):
    renamed = awkward
    assert sharding.shard(renamed, limit=1000).columns == [*renamed.columns, "shard_id"]
    assert sharding.shard(renamed, limit=1000).count() == awkward.count() and sharding.shard(nothing, limit=10).count() == 0


# -- 10 -----------------------------------------------------------------------------------------


def test_leaks_and_paraphrases(spark):
    rng = np.random.default_rng(2)
    vocabulary = np.array([f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)])
    text = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(15, 60)))) for i in range(30)]
    docs, planted = [], set()
    for d in range(300):
        w = text(int(rng.integers(40, 300)))
        if d % 3 == 0:
            i, item = items[d // 3 % 30]
            item = list(item)
            if d % 2:  # a paraphrase: some words changed, some left out
                for k in rng.choice(len(item), len(item) // 8, replace=False):
                    item[k] = "other"
            at = int(rng.integers(0, len(w)))
            w[at:at] = item
            planted.add((d, i))
        docs.append((d, " ".join(w)))
    out = decontamination.contaminated(spark.createDataFrame([*docs, (None, None), (-1, "")], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (98, "")], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in out.collect()}
    assert len(got & planted) >= 0.9 * len(planted) and len(got - planted) <= 2


def test_exact_leaks_are_found(spark, folder):
    folder = folder.replace("0.001", "0.01")
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    want = {(r[0], r[1]) for r in docs.join(items.withColumnRenamed("text", "t"), F.col("text").contains(F.col("t"))).select("doc_id", "item_id").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert want <= got
    assert decontamination.cleaned(docs, items).count() == docs.count() - len({d for d, _ in got})


def _words(rng, n, k=3000):
    vocabulary = np.array([f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(k)])
    return [str(w) for w in rng.choice(vocabulary, n)]


def _leaked(spark, docs, items):
    """Pairs that are found, and whether the cleaned table has just the documents of none."""
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert {r["doc_id"] for r in decontamination.cleaned(docs, items).collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}
    return got


def test_items_of_common_words_are_found(spark):
    rng = np.random.default_rng(4)
    often = [f"often{c}" for c in "abcdefghijklmnopqrst"]
    items = [(0, _words(rng, 30)), (1, often[:18])]  # one in a third of the documents, one of words that all documents have
    docs, planted = [], set()
    for d in range(90):
        w = [*_words(rng, 100), *rng.permutation(often).tolist()]
        if d % 3 == 0:
            w[20:20] = items[0][1]
            planted.add((d, 0))
        if d % 10 == 1:
            w[60:60] = items[1][1]
            planted.add((d, 1))
        docs.append((d, w))
    got = _leaked(spark, docs, items)
    assert planted <= got and {x for x in got - planted if x[1] == 0} == set()


def test_items_of_a_small_table_are_found(spark):
    item = _words(np.random.default_rng(6), 20)
    assert _leaked(spark, [(d, item) for d in range(4)], [(0, item)]) == {(d, 0) for d in range(4)}


def test_long_items_lose_no_direction(spark):
    """Their passages are more than a block's rank; every sixth word is changed, so no copy is exact."""
    rng = np.random.default_rng(8)
    items = [(i, _words(rng, 300, 15000)) for i in range(200)] + [(999, _words(rng, 12000, 15000))]
    docs, planted = [], set()
    for i, w in items[:40]:
        docs.append((i, [*_words(rng, 60, 15000), *(x if k % 6 else "other" for k, x in enumerate(w)), *_words(rng, 60, 15000)]))
        planted.add((i, i))
    docs.append((999, [x if k % 6 else "other" for k, x in enumerate(items[-1][1])]))
    docs += [(1000 + d, _words(rng, 200, 15000)) for d in range(100)]
    assert _leaked(spark, docs, items) == planted | {(999, 999)}


def test_blocks_are_bounded():
    rng = np.random.default_rng(9)
    items = [(i, " ".join(_words(rng, int(rng.integers(1, 900)), 15000))) for i in range(300)] + [(400, " ".join(_words(rng, 12000, 15000))), (401, None)]
    most, idf = decontamination.most_passages(), np.ones(decontamination.COUNTERS, np.float32)
    groups = list(decontamination.dealt(items, most))
    assert sorted(i for rows, _ in groups for i, _ in rows) == [*range(300), 400]
    for rows, n in groups:
        blocks = [decontamination.make_block(rows, idf, slice(k, k + most)) for k in range(0, n, most)]
        assert sum(len(b.item) for b in blocks) == n and all(len(b.item) <= most and len(b.vocabulary) <= decontamination.VOCABULARY for b in blocks)
        assert all(len(b.words[0]) for b in blocks)


def test_short_items_are_found(spark):
    rng = np.random.default_rng(10)
    items = [(n, [f"item{chr(97 + n)}{chr(97 + k)}" for k in range(n)]) for n in (1, 2, 4, 5, 7, 8, 12)]
    docs, planted = [], set()
    for d in range(200):
        w = _words(rng, 120, 15000)
        for n, item in items[d % 3 :: 3]:
            w[50:50] = item
            planted.add((d, n))
        docs.append((d, w))
    docs.append((500, [x for _, w in items[1:] for x in w[:-1]]))  # no item is whole
    got = _leaked(spark, docs, items)
    assert planted <= got and {x for x in got - planted if x[0] < 500 or x[1] < 8} == set()


def test_decontamination_on_awkward(spark, awkward, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta eta theta"), (4, "- -")], "item_id long, text string")
    assert decontamination.cleaned(awkward, items.limit(0)).count() == awkward.count()
    assert decontamination.cleaned(awkward, items).columns == awkward.columns
    assert decontamination.contaminated(nothing, items).count() == 0


def test_latent_recall_against_every_window(spark, folder):
    """Every leak that the subsequence rule sees in some window of a document, of any item."""
    import pyarrow as pa

    folder = folder.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    from quire.llm import text as X

    rows, wanted = docs.orderBy("doc_id").limit(300).collect(), items.collect()
    h, first = decontamination.word_hashes(*X.utf8(pa.array([r["text"] for r in rows])))
    g, begin = decontamination.word_hashes(*X.utf8(pa.array([r["text"] for r in wanted])))
    want = set()
    for i, r in enumerate(rows):
        words = h[first[i] : first[i + 1]]
        for k, w in enumerate(wanted):
            item = g[begin[k] : begin[k + 1]]
            if len(np.intersect1d(item, words)) < decontamination.WEAK * len(np.unique(item)):
                continue
            n = decontamination.WIDTH + 2 * len(item)
            if any(decontamination.leaks(item, words[a : a + n]) for a in range(0, max(1, len(words) - n + decontamination.STRIDE), decontamination.STRIDE)):
                want.add((r["doc_id"], w["item_id"]))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows])), items).collect()}
    assert len(want) > 5 and len(got & want) >= 0.9 * len(want)


def test_answers_decide_weak_overlaps():
    item = np.arange(1, 21)
    weak = np.concatenate([item[:9], [90, 91], item[-4:]])  # 13 of 20 in order, most of the answer
    assert decontamination.leaks(item, weak) == pytest.approx(0.65)
    assert decontamination.leaks(item, np.concatenate([item[:13], [90, 91]])) == 0.0
    assert decontamination.leaks(item, item[:14]) == pytest.approx(0.7)
    assert decontamination.leaks(item, item[:9]) == 0.0


def test_basis_holds_most_of_every_passage():
    rng = np.random.default_rng(0)
    kinds = rng.random((10, 300)) * (rng.random((10, 300)) < 0.2)
    own = rng.random((60, 10)) @ kinds + 0.01 * rng.random((60, 300))
    v = decontamination.directions(own, rng.normal(size=(8, 300)) * 0.01)
    assert v.shape[1] < 20 and (np.square(own @ v).sum(1) >= decontamination.ENERGY * np.square(own).sum(1) * 0.999).all()
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-8)


def test_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 3, 9, 5, 4])
    assert decontamination.common_subsequence(a, b)[0] == 3


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, folder):
    import corpus_pipeline as P

    folder = folder.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = store.written(P.select_quality(spark, docs, folder), "t")
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and sum(q == 1 and d not in ids for d, q in labels.items()) <= 0.01 * len(labels)
    assert sum(q == 0 and d in ids for d, q in labels.items()) <= 0.01 * len(labels)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    apart = store.written(P.drop_near_duplicates(spark, kept, folder), "t")
    assert sorted(r["doc_id"] for r in apart.select("doc_id").collect()) == sorted({c if n else d for d, n, c in brute_components(rows)})
    clean = store.written(P.drop_leaks(spark, apart, folder), "t")
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not [1 for r in clean.collect() if any(i in r["text"] for i in items)]
    assert apart.count() - clean.count() <= sum(any(i in r["text"] for i in items) for r in apart.collect()) + 2
    mixed = store.written(P.mix_sources(spark, clean, folder), "t")
    size = {r["source"]: r["source_size"] for r in mixing.targets(clean.select("source", mixing.n_words(F.col("text")).alias("size"))).collect()}
    assert abs(mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] / (1.5 * sum(size.values())) - 1) < 0.05
    out = P.deal_shards(spark, mixed, folder)
    assert out.columns == [*docs.columns, "shard_id"] and out.count() == mixed.count()
    assert out.groupBy("shard_id").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] <= sharding.OP9_LIMIT


def test_pipeline_on_awkward(spark, awkward, tmp_path):
    import corpus_pipeline as P

    for name, docs in (("awkward", awkward.drop("__hash", "size", "cid", "slice")), ("empty", awkward.drop("__hash", "size", "cid", "slice").limit(0))):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "phi chi psi omega")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out = P.run(spark, at)
        assert out.columns == [*docs.columns, "shard_id"] and (out.count() > 0) == (name == "awkward")
