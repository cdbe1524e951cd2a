"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing column names."""

import math

import pytest
from pyspark.sql import functions as F

import brute
from tallyline.llm import exact_dedup, line_dedup, lm_scoring, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, queries, secrets



def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def pairs(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


@pytest.fixture(scope="module")
def plain(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


def test_exact(odd, none, plain):
    assert exact_dedup.exact_groups(none).count() == 0
    for keep, best in (("smallest", min), ("largest", max)):
        found = exact_dedup.exact_groups(odd, keep=keep).collect()
        groups = {}
        for i, t in plain:
            groups.setdefault(t or "", []).append(i)
        expected = []
        for members in groups.values():
            ids = [i for i in members if i is not None]
            stays = best(ids) if ids else None
            expected += [(i, stays, len(members), i == stays) for i in members]
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str) == sorted(expected, key=str)


def test_exact_tells_colliding_texts_apart(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "ab"), (5, "b"), (6, None), (7, "")], "doc_id int, text string")
    found = exact_dedup.exact_groups(docs, content_hash=lambda t: F.substring(t, 1, 1)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == {1: (1, 2), 3: (1, 2), 2: (2, 2), 4: (2, 2), 5: (5, 1), 6: (6, 2), 7: (6, 2)}
    assert len({r.text_sha256 for r in found}) == 4


def test_near(odd, none, plain):
    assert near_dedup.near_groups(none).count() == 0
    assert near_dedup.keep_one_of_each(none).schema == none.schema
    found = near_dedup.near_groups(odd, 3, 85).collect()
    assert len(found) == len(plain)
    by = {}
    for r in found:
        by.setdefault((r.doc_id, r.n_shingles), set()).add(r.component_id)
    assert by[(1, 0)] == {1} and by[(2, 0)] == {2} and by[(4, 0)] == {4}
    assert by[(9, 1)] == by[(10, 1)] == {9} and by[(11, 1)] == {11}
    assert by[(6, 2998)] == by[(7, 2999)] == by[(13, 2998)] == {6}
    assert by[(None, 0)] == {None}
    kept = near_dedup.keep_one_of_each(odd, 3, 85)
    assert kept.schema == odd.schema
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(i for i, _ in ids if i is not None and i > 5) == [6, 8, 9, 11, 12, 14]
    assert sorted(t[:6] for i, t in ids if i == 5) == ["A line", "the sa"]
    assert len([1 for i, _ in ids if i is None]) == 2


def test_lines(odd, none, plain):
    assert line_dedup.drop_repeated_lines(none).schema.names == [*none.columns, "n_removed"]
    found = line_dedup.drop_repeated_lines(odd)
    assert found.columns == [*odd.columns, "n_removed"]
    found = [(r.doc_id, r.text, r.n_removed) for r in found.collect()]
    assert len(found) == len(plain)
    # The row without an identifier comes first, so document 5 loses the line that both have.
    assert [t for i, t, n in found if i == 5 and n] == ["quite another line with some words"] * 2
    assert [t for i, t, n in found if i == 14] == ["again and again and again the same"]
    assert [n for i, t, n in found if i == 1] == [0] and [t for i, t, n in found if i == 1] == [None]
    # Long lines count beyond 511 words; the fuzzy copy and the exact one go.
    assert {i: n for i, t, n in found if i in (6, 7, 13)} == {6: 0, 7: 1, 13: 1}
    left = line_dedup.drop_repeated_lines(odd, drop_empty=True).collect()
    assert not {7, 13} & {r.doc_id for r in left} and {1, 2, 4, 6, 8, 9} <= {r.doc_id for r in left}


def test_documents_keep_their_own_short_lines(spark):
    shared_line = "this license line is in every document here"
    texts = {1: shared_line, 2: f"{shared_line}\nmy own title\n\n- a list", 3: f"{shared_line}\n --- \n", 4: "---", 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_repeated_lines(docs, drop_empty=True).collect()}
    assert left == {1: (shared_line, 0), 2: ("my own title\n\n- a list", 1), 4: ("---", 0), 5: ("", 0)}


def test_blocks_find_every_near_hash(spark):
    near = [0b111 << 20, (1 << 59) | 1 | (1 << 30), 0]
    for m in (5, 6, 7):
        df = spark.createDataFrame([(x,) for x in near], "sim long").select(line_dedup.block_keys(F.col("sim"), m).alias("k"))
        keys = [set(r.k) for r in df.collect()]
        assert keys[0] & keys[2] and keys[1] & keys[2]
    assert [line_dedup.block_count(n) for n in (0, 1000, 2_000_000, 10**8, 10**11)] == [5, 5, 5, 6, 9]


def test_packing(odd, none, plain):
    load = queries.tokenizer()
    assert packing.pack(packing.pieces(none, load)).count() == 0
    packed = packing.pack(packing.pieces(odd, load, capacity=64, with_ids=True), capacity=64)
    found = packed.collect()
    encode = load()
    assert sum(r.length for r in found) == sum(len(encode(t or "")) + 1 for _, t in plain)
    assert [(r.length, r.ids) for r in found if r.doc_id == 1] == [(1, [2])]
    together = packing.sequences(packed).collect()
    assert all(0 < len(r.ids) <= 64 for r in together)
    ids = {r.sequence_id: r.ids for r in together}
    assert all(ids[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in found)


def test_mixing(odd, none, plain):
    assert mixing.mix(none, levels(), 0.5).count() == 0
    assert mixing.keep_reached(none, levels(), 0.5).schema == none.schema
    found = mixing.mix(odd, levels(), 2.5, epochs=3, seed=5).collect()
    expected = brute.mixed([(i, ("", ""), t) for i, t in plain], 2.5, {}, 3, 5)
    assert sorted(((r.doc_id, r.n_tokens, r.epochs, r.last_tokens) for r in found), key=str) == sorted(
        ((i, n, full, last) for i, _, n, _, full, last in expected), key=str
    )
    assert pairs(mixing.keep_reached(odd, levels(), 1.0).collect()) == sorted(plain, key=str)
    kept = mixing.keep_reached(odd, levels(), 100, seed=5)
    assert kept.schema == odd.schema and {1, 2, 4} <= {r.doc_id for r in kept.collect()}


def test_shortages_stay_in_the_family(spark):
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 5, ("b", "y"): 7}
    df = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "l1 string, l2 string, capacity long")
    for budget in (0, 9, 200, 1000, 5000):
        for weights in ({}, {("a",): 1, ("b",): 3, ("a", "x"): 4}, {("b", "y"): 0}):
            found = {(r.l1, r.l2): int(r.budget) for r in mixing.allocate(df, ["l1", "l2"], budget, weights).collect()}
            expected = brute.tree_budgets(leaves, budget, weights)
            assert {p: found.get(p, 0) for p in leaves} == expected


def test_spans(odd, none, plain):
    for find, columns in ((pii.find_pii, ("plain", "hidden")), (secrets.find_secrets, ("strong", "linked"))):
        assert find(none).count() == 0
        found = find(odd).collect()
        assert len(found) == len(plain) and all(r[c] == [] for r in found for c in columns)


def test_rules(odd, none, plain):
    assert quality_rules.ledger(none).count() == 0
    found = quality_rules.ledger(odd).collect()
    assert sorted(tuple(r[k] for k in quality_rules.MEASURES) for r in found) == sorted(
        tuple(brute.rule_measures(t)[k] for k in quality_rules.MEASURES) for _, t in plain
    )
    kept = quality_rules.keep_documents(odd)
    assert kept.schema == odd.schema
    kept = {r.doc_id for r in kept.collect()}
    assert kept >= {5, 9, 10, 11} and not kept & {1, 2, 4, 8, 14}


def test_ledger_policies(odd):
    rows = quality_rules.ledger(odd).cache()
    policy = quality_rules.FULL_POLICY
    kept = quality_rules.apply_policy(rows, policy)
    assert kept.filter("kept").count() == rows.filter(F.col("failures").bitwiseAND(F.lit(policy.bits())) == 0).count()
    found = {r.rule: r for r in quality_rules.ablations(rows, policy).collect()}
    for k, rule in enumerate(quality_rules.RULES):
        others = quality_rules.Policy("o", tuple(r for r in policy.rejects if r != rule.name))
        saved = quality_rules.apply_policy(rows, others).filter("kept").count() - kept.filter("kept").count()
        assert found[rule.name].only_this_rule == saved
        assert found[rule.name].failed == rows.filter(rule.fails).count()
    with pytest.raises(ValueError):
        quality_rules.Policy("x", ("no such rule",)).bits()


def test_classifier(spark, odd, none):
    assert quality_classifier.document_statistics(none).count() == 0
    rows = quality_classifier.document_statistics(odd).cache()
    labels = spark.createDataFrame([(1, 0), (2, 0), (8, 0), (5, 1), (6, 1), (9, 1), (10, None), (11, 7)], "doc_id long, quality int")
    model = quality_classifier.fit(rows.join(labels, "doc_id"))
    scores = [r.score for r in quality_classifier.score(rows, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 and not math.isnan(s) for s in scores)
    one = quality_classifier.fit(rows.join(labels.filter("quality = 1"), "doc_id"))
    assert {r.score for r in quality_classifier.score(rows, one).collect()} == {1.0}
    nothing = quality_classifier.fit(rows.join(labels.limit(0), "doc_id"))
    assert {r.score for r in quality_classifier.score(rows, nothing).collect()} == {0.5}


def test_scoring(odd, none, plain):
    assert lm_scoring.score_texts(none, F.lit(True)).count() == 0
    found = lm_scoring.score_texts(odd, F.col("doc_id") % 2 == 0).collect()
    assert len(found) == len(plain)
    train = [(i, t) for i, t in plain if i is not None and i % 2 == 0]
    assert {r.train_tokens for r in found} == {sum(len(brute.words(t)) + 1 for _, t in train)}
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.base_score) for r in found)
    assert {r.n_tokens for r in found if r.doc_id == 1} == {1}
    unlearned = lm_scoring.score_texts(odd, F.lit(None).cast("boolean")).collect()
    assert {r.base_score for r in unlearned} == {0.0} and all(math.isfinite(r.score) for r in unlearned)


def test_scoring_sends_its_tables_in_single_precision(odd):
    """Every worker keeps what is sent: one float for each slot's count and one for what it says, not cells and sums to make them from."""
    rows = odd.select("text", F.lit(True).alias("train"))
    centres = lm_scoring.fit_kinds(rows)
    corpus, _ = lm_scoring.learn(rows, lm_scoring.stored(lm_scoring._units(rows, centres), "units"), centres)
    assert [(t.dtype.str, t.size) for t in corpus.model.tables] == [("<f4", lm_scoring.cm.TABLES << lm_scoring.cm.TABLE_BITS)] * 2
