"""Near duplicates against brute force over all pairs, the alignment, cases."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm.neardup import SHORT, OrderMinHash, alike, classes, distance, keep_one, rarely_shared, searched


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 14))
def test_banded_distance(a, b, most):
    want, got = levenshtein(a, b), distance(list(a), list(b), most)
    assert got == want if want <= most else got > most


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    texts, passage = [], [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 300))]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            rate = rng.choice([0.0, 0.03, 0.08])
            texts.append([w for x in base for w in ([word()] if rng.random() < rate else [x, word()] if rng.random() < rate / 4 else [x])])
    for _ in range(6):  # different texts that share a passage
        texts.append([word() for _ in range(200)] + passage + [word() for _ in range(200)])
    return [" ".join(t) for t in texts]


def test_classes_equal_brute_force(spark):
    texts = corpus()
    texts += [texts[0], texts[0], "one two", "one two", "one three", "", None, " "]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            same = (a or "") == (b or "") or ((a or "").split() and (b or "").split() and alike(a or "", b or ""))
            if same:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in classes(df).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert sorted(r["doc_id"] for r in keep_one(df).collect()) == sorted(set(got.values()))


def test_cases(spark):
    schema = "doc_id long, text string"
    rows = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (None, "same words here"), (None, "other text of its own")], schema)
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in classes(rows).collect()) == [("1", "1", 3), ("1", "1", 3), ("None", "1", 3), ("None", "None", 1)]
    assert keep_one(rows).count() == 2
    assert classes(rows.limit(0)).count() == 0 and keep_one(rows.limit(0)).count() == 0


def test_order_matters():
    keys = OrderMinHash().keys
    a = [f"w{i}" for i in range(40)]
    same, swapped = keys(" ".join(a).encode())[0], keys(" ".join(a[20:] + a[:20]).encode())[0]
    assert (same == keys(" ".join(a).encode())[0]).all() and 0 < (same == swapped).sum() < len(same)


def sharing(texts):
    """The least index of each text's class, by trying all pairs that share a key."""
    keys = [OrderMinHash().keys(t.encode())[0] for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and (keys[i] == keys[j]).any() and alike(texts[i], texts[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_copies_alike_to_their_base_only(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    texts = []
    for size, copies in ((400, 300), (150, 40)):
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(copies):
            rate = rng.uniform(0.10, 0.15)
            texts.append(" ".join(word() if rng.random() < rate else w for w in base))
    want = sharing(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in classes(df).collect()}
    assert got == dict(enumerate(want)) and want.count(0) > 250


def test_texts_of_large_keys_are_paired_by_what_they_rarely_share(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(k)] for k in (20, 40)]
    texts = []
    for _ in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] + rng.choice([[], *passages])
        texts.append(base)
        if rng.random() < 0.4:
            changed = list(base)
            for i in rng.sample(range(len(base)), len(base) // 5):
                changed[i] = rng.choice(vocabulary)
            texts.append(changed)
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, label long, text string")
    got = {tuple(r) for r in rarely_shared(df).collect()}
    want = {(i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if alike(a, b)}
    assert len(want) > 50 and want <= got


def test_small_keys_are_tried_pair_by_pair(spark):
    texts = [" ".join(f"w{g}x{'y' * (i == k)}{i}" for i in range(12 + g)) for g in range(6) for k in range(5)]
    rest = spark.createDataFrame([(i % 2, i, i) for i in range(len(texts))] + [(2, i, i) for i in range(len(texts))], "key long, node long, label long")
    group = list(range(len(texts)))
    for a, b in searched(rest, spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect():
        x, y = group[a], group[b]
        group = [x if g == y else g for g in group]
    assert len(set(group)) == 6 and all(len(set(group[5 * g : 5 * g + 5])) == 1 for g in range(6))


def test_recall_by_edit_rate():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    keys, found = OrderMinHash().keys, {}
    for percent in (5, 10, 12, 15, 18, 19, 20):
        hit = 0
        for _ in range(300):
            base = [word() for _ in range(200)]
            changed = list(base)
            for i in rng.sample(range(200), 2 * percent):
                changed[i] = word()
            a, b = " ".join(base), " ".join(changed)
            assert alike(a, b)
            hit += bool((keys(a.encode())[0] == keys(b.encode())[0]).any())
        found[percent] = hit / 300
    print("recall by percent of words replaced:", found)
    assert min(found.values()) >= 0.9 - 0.03 and all(found[p] >= 0.95 for p in (5, 10, 12, 15)), found


def test_short_texts_are_all_found(spark):
    """Pairs of every length up to SHORT with as many words replaced as are allowed, and one base with many copies."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6)))
    pairs, rows = [], []
    for n in (5, 6, 8, 10, 12, 15, 20, 25, 30, 35, SHORT):
        for _ in range(20):
            base = [word() for _ in range(n)]
            changed = list(base)
            for i in rng.sample(range(n), n // 5):
                changed[i] = word()
            pairs.append((n, len(rows), len(rows) + 1))
            rows += [" ".join(base), " ".join(changed)]
    base = [word() for _ in range(10)]
    hot = range(len(rows), len(rows) + 151)
    rows += [" ".join(base), *(" ".join(word() if i in (k % 10, k // 10 % 10) else w for i, w in enumerate(base)) for k in range(150))]
    rows += ["", " ", "one two three four", "one  two three four", "one two three five"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in classes(df).collect()}
    missed = [(n, a) for n, a, b in pairs if got[a] != got[b]]
    assert not missed and len({got[i] for i in hot}) == 1
    assert got[len(rows) - 3] == got[len(rows) - 2] != got[len(rows) - 1]


def test_a_common_head_with_pairs_of_tails(spark, monkeypatch):
    monkeypatch.setattr("folio.llm.neardup.SMALL_TEXTS", 4)
    monkeypatch.setattr("folio.llm.neardup.RARE", 4)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7)))
    head, rows = [word() for _ in range(78)], []
    for pair in range(12):
        tail = [word() for _ in range(22)]
        rows += [(2 * pair, " ".join(head + tail)), (2 * pair + 1, " ".join(head + tail[:-1] + [word()]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * p][0] == got[2 * p + 1][0] and got[2 * p][1] for p in range(12))


def test_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 99_999)}" for _ in range(200_000)]
    copy = list(words)
    for i in rng.sample(range(len(copy)), 500):
        copy[i] = "changed"
    rows = [(1, " ".join(words), 1, "x"), (2, " ".join(copy), 2, "y"), (3, "short", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest long, kept_id string")
    assert {r["doc_id"]: r["class_id"] for r in classes(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(map(tuple, keep_one(df).select("doc_id", "digest", "kept_id").collect())) == [(1, 1, "x"), (3, 3, "z")]


def test_working_tables_are_dropped(spark, tmp_path):
    """The table of levels is freed once used, and labels, edges and tokens once superseded."""
    from pyspark.core.broadcast import Broadcast

    from folio.llm import neardup

    made, freed = [], []
    create, destroy = spark.sparkContext.broadcast, Broadcast.destroy
    texts = [" ".join(f"w{(i * 7 + k * (1 + i % 3)) % 50}" for k in range(12)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [t + " more" for t in texts])], "doc_id long, text string")
    names = []
    keep = neardup.written
    try:
        spark.sparkContext.broadcast = lambda value: made.append(create(value)) or made[-1]
        Broadcast.destroy = lambda self, *a: freed.append(self) or destroy(self, *a)
        neardup.written = lambda df, name: names.append((name, keep(df, name))) or names[-1][1]
        got = neardup.classes(docs).collect()
    finally:
        del spark.sparkContext.broadcast
        Broadcast.destroy, neardup.written = destroy, keep
    assert len(got) == 80 and made and len(freed) == len(made)
    import os

    left = [name for name, df in names if name in ("edges", "first-pairs", "met-pairs", "rare-pairs", "rare-words") and any(os.path.exists(f.replace("file://", "")) for f in df.inputFiles())]
    assert not left


def test_a_text_is_joined_once_with_all_its_keys_and_tokens(spark, monkeypatch):
    from folio.llm import neardup

    joined = {}

    def rows_of_join(df):
        """Rows that the join by node made, as counted while it ran."""
        df.collect()
        plans, found = [df._jdf.queryExecution().executedPlan()], []
        while plans:
            plan = plans.pop()
            name = plan.nodeName()
            if name == "AdaptiveSparkPlan":
                plans.append(plan.executedPlan())
            elif "QueryStage" in name:
                plans.append(plan.plan())
            else:
                if "Join" in name and "node" in plan.simpleString(100):
                    found.append(plan.metrics().apply("numOutputRows").value())
                plans += [plan.children().apply(i) for i in range(plan.children().size())]
        return found

    rest = spark.createDataFrame([(k, n, n) for k in range(30) for n in range(4)], "key long, node long, label long")
    texts = spark.createDataFrame([(n, f"text {n}") for n in range(4)], "node long, text string")
    rows = neardup.with_texts(rest, texts)
    assert rows_of_join(rows) == [4]
    assert sorted((r["key"], r["node"], r["label"], r["text"]) for r in rows.collect()) == [(k, n, n, f"text {n}") for k in range(30) for n in range(4)]

    kept = neardup.written

    def spied(df, name):
        if name == "rare-pairs":
            joined[name] = rows_of_join(df)
        return kept(df, name)

    monkeypatch.setattr(neardup, "written", spied)
    words = [f"w{i}" for i in range(30)]
    labelled = spark.createDataFrame([(n, n, " ".join([*words, f"x{n}"])) for n in range(6)], "node long, label long, text string")
    assert {(r["a"], r["b"]) for r in neardup.rarely_shared(labelled).collect()} == {(a, b) for a in range(6) for b in range(a + 1, 6)}
    assert joined["rare-pairs"] == [6]


def test_shared_tokens_agree_with_plain_counts(spark):
    from collections import Counter, defaultdict

    from folio.llm import neardup

    rng = random.Random(31)
    rows = [(7 * i - 300, rng.randint(0, 12), sorted(rng.sample([v * (1 << 55) + v for v in range(-120, 120)], rng.randint(1, 30)))) for i in range(150)]
    holders = defaultdict(list)
    for node, label, tokens in rows:
        for t in tokens:
            holders[t].append(label)
    firsts = spark.createDataFrame([(n, c, 9, len(t), t) for n, c, t in rows], "node long, label long, n long, n_tokens long, tokens array<long>").repartition(4)
    found = neardup.shared_tokens(firsts)
    got = {r["node"]: r["found"] for r in found.collect()}
    want = {n: [t for t in sorted(tokens) if len(set(holders[t])) > 1] for n, _, tokens in rows}
    assert {n: [x["token"] for x in f] for n, f in got.items()} == {n: t for n, t in want.items() if t}
    for f in got.values():
        for x in f:
            counts = Counter(holders[x["token"]])
            assert x["held"] == counts.total() and counts[x["main"]] == max(counts.values())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_a_pair_is_met_at_one_token_and_tried_at_one_key(spark, monkeypatch):
    from folio.llm import neardup

    # two long texts of 200 tokens in common: one row, not one for each token
    tokens = list(range(200))
    found = neardup.shared_tokens(spark.createDataFrame([(n, n, 900, 200, tokens) for n in (1, 2)], "node long, label long, n long, n_tokens long, tokens array<long>"))
    rows = neardup.holding(spark.createDataFrame([(1, 1, 900), (2, 2, 900)], "node long, label long, n long"), found)
    assert all(len(r["head"]) == 200 and r["n_tokens"] == 200 for r in rows.collect())
    pairs = neardup.paired(rows, 1)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    plans, made = [pairs._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            plans.append(plan.plan())
        else:
            if "Join" in plan.nodeName() and "label_a" in plan.simpleString(1000):
                made.append(plan.metrics().apply("numOutputRows").value())
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    assert made == [1]

    asked = []
    monkeypatch.setattr(neardup, "close", lambda x, y: asked.append((x, y)))
    for key in (3, 5, 8):
        neardup.tried(key, [1, 2], [1, 2], ["a b c d e f", "a b c d e g"], [[8, 5, 3], [9, 5, 8]])
    assert len(asked) == 1


def test_the_table_of_levels_comes_in_one_job(spark):
    """Not partition by partition: with many partitions that took longer than the work."""
    from folio.llm import neardup

    texts = spark.createDataFrame([(n, n, " ".join(f"w{(n + k) % 40}" for k in range(20))) for n in range(30)], "node long, label long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    context = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("levels", "levels")
        table = neardup.levels(texts, 1)
        jobs = len(context.statusTracker().getJobIdsForGroup("levels"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(table) == 1 << neardup.TABLE_BITS and any(table)
    assert jobs <= 8, jobs
