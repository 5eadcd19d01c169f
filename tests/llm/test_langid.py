"""Language ID: held-out accuracy, mixed texts, the exact path, cases."""

import itertools

import numpy as np

from folio.llm.langid import ORDERS, SWITCH, best_path, fit, fold, identify, op1_langid, tables


def test_held_out_accuracy(spark, data):
    rows = op1_langid(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_path_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.normal(size=(6, 3)) * 3
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(value(best_path(s, 2.0)) - max(map(value, itertools.product(range(3), repeat=6)))) < 1e-9


def test_spans_of_a_mixed_text_and_cases(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = fit(docs.where(fold() != 0))
    sample = {lang: docs.where(f"lang = '{lang}' AND n_chars > 1500 AND text NOT LIKE '%|%'").first()["text"][:800] for lang in ("en", "de")}
    mixed = sample["en"] + "\n" + sample["de"]
    rows = [(1, mixed, "x"), (2, None, "x"), (3, "", "x"), (4, "123 !?", "x"), (5, sample["de"] * 300, "x"), (5, sample["de"], None)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert {s["lang"] for s in by[1]["spans"]} == {"en", "de"}
    cut = [s for s in by[1]["spans"] if s["lang"] == "de"][0]["start"]
    assert abs(cut - len(sample["en"])) < 60
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (2, 3, 4)) and by[5]["lang_pred"] == "de"
    assert identify(docs.limit(0).select("doc_id", "text"), model).count() == 0
    none = fit(docs.limit(0))
    assert identify(docs.limit(3).select("doc_id", "text"), none).first()["lang_pred"] == "und"


def test_the_model_follows_the_rows_not_their_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text", "lang")
    one, *others = [fit(d, sample=20) for d in (docs.coalesce(1), docs.repartition(3), docs.union(docs).repartition(16))]
    for m in others:
        assert m.languages == one.languages and np.array_equal(m.table, one.table) and np.array_equal(m.scripts, one.scripts)


def test_more_languages_than_a_table_of_full_width_holds(spark):
    n = 5000
    rows = spark.range(n).selectExpr("concat('l', id) AS lang", "repeat(concat(translate(hex(xxhash64(id)), '0123456789', 'ghijklmnop'), ' '), 4) AS text")
    model = fit(rows.union(rows.where("lang = 'l7'")))
    assert len(model.languages) == n and model.table.size <= 1 << 25
    got = identify(rows.where("pmod(xxhash64(lang), 100) = 0"), model).select("lang", "lang_pred").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.9


def plain(text, model, penalty):
    """Language and score of a text, letter by letter and over all paths of a full Viterbi table."""
    lower, script = tables()
    words, word = [], []
    for ch in text + "\n":
        if lower[ord(ch)]:
            word.append(ord(ch))
        elif word:
            words.append(word)
            word = []
    if not words:
        return "und", 0.0
    scores = []
    for w in words:
        codes = [0, *(int(lower[c]) for c in w), 0]
        total = np.zeros(len(model.languages))
        for order in ORDERS:
            for end in range(1, len(codes)):
                gram = codes[max(0, end - order + 1) : end + 1]
                if len(gram) < order or (order > 2 and 0 in gram[1:-1]):
                    continue
                h = order
                for c in gram:
                    h = ((h ^ c) * 0x9E3779B1) & 0xFFFFFFFF
                    h ^= h >> 15
                total += model.table[((h * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - model.bits)]
        may = model.scripts[script[w[0]]]
        scores.append(np.where(may, total, -1e4) if may.any() else total * 0)
    value, back = scores[0], []
    for s in scores[1:]:
        move = value[None, :] - penalty * (1 - np.eye(len(value)))
        back.append(move.argmax(1))
        value = move.max(1) + s
    path = [int(value.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    path = path[::-1]
    weight = np.bincount(path, weights=[len(w) for w in words], minlength=len(value))
    best = int(weight.argmax())
    own = sum(s for s, k in zip(scores, path) if k == best)
    return model.languages[best], weight[best] / weight.sum() / np.exp(np.clip(own - own[best], -700, 50)).sum()


def test_query_equals_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = fit(docs.where(fold() != 0))
    rows = {r["doc_id"]: r for r in identify(docs.select("doc_id", "text"), model).collect()}
    for doc_id, text in docs.where("n_chars < 4000").select("doc_id", "text").collect():
        lang, score = plain(text or "", model, SWITCH)
        assert rows[doc_id]["lang_pred"] == lang and abs(rows[doc_id]["score"] - min(1, score)) < 0.01


def test_rows_of_one_id_and_many_languages(spark):
    rows = spark.range(20_000, numPartitions=4).selectExpr("7L AS doc_id", "'the same words of a hot id' AS text", "'en' AS lang")
    model = fit(rows)
    assert model.languages == ["en"] and identify(rows.limit(2), model).first()["lang_pred"] == "en"
    many = spark.range(600).selectExpr("id AS doc_id", "concat('word', char(97 + id % 26), char(97 + id div 26), ' of it') AS text", "concat('l', id) AS lang")
    model = fit(many)
    assert len(model.languages) == 600 and model.table.size <= 1 << 25
