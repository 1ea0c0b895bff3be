"""Digests merge: a tree that is changed by deltas equals one built anew; regions and sets of tables have versions."""

from pyspark.sql import functions as F

from lorewell.operators import digests, stats

COLUMNS = ["id", "label", "x"]


def leaves(spark, rows, tbl="t"):
    return digests.leaves(spark.createDataFrame(rows, "id long, label string, x string").repartition(3), tbl, "label", COLUMNS)


def content(frame):
    return sorted(map(tuple, frame.collect()))


def test_changes_equal_a_rebuild_and_touch_their_path_alone(spark, tmp_path):
    rows = [(i, f"{'abc'[i % 3]}/{i % 7}/long label {i % 11}", f"v{i}") for i in range(200)] + [(900, None, None), (901, "", ""), (902, "a", "1"), (902, "a", "1")]
    new = [(902, "a", "1"), (5, "c/5/long label 5", "other"), (999, "z", None)]
    gone = [r for r in rows if r[0] in (5, 902)]
    folder = str(tmp_path / "tree")
    digests.append(digests.tree(leaves(spark, rows)), folder)
    delta = digests.change(leaves(spark, gone), leaves(spark, new))
    assert delta.count() <= 3 * (digests.DEPTH + 2)
    digests.append(delta, folder)
    stored, rebuilt = spark.read.parquet(folder), digests.tree(leaves(spark, [r for r in rows if r not in gone] + new))
    assert content(digests.compact(stored)) == content(digests.compact(rebuilt))
    assert content(digests.versions(stored)) == content(digests.versions(rebuilt))
    for region in ("", "a", "c/5", "c/5/long label 5", "nothing"):
        assert content(digests.region_version(stored, region)) == content(digests.region_version(rebuilt, region))
    before = digests.tree(leaves(spark, rows))
    version = lambda f, r: digests.region_version(f, r).first().version
    assert version(stored, "b/") == version(before, "b/") and version(stored, "c/5") != version(before, "c/5")


def test_rows_that_read_alike_differ_and_tables_count(spark):
    one = digests.tree(leaves(spark, [(1, "a", None)]))
    assert content(digests.versions(one)) != content(digests.versions(digests.tree(leaves(spark, [(1, "a", "-")]))))
    two = one.union(digests.tree(leaves(spark, [(1, "b", "x")], "u")))
    version = lambda f, t, a="rules/1": digests.ruleset_version(f, t, a).first().version
    assert len({version(two, ["t", "u"]), version(two, ["t"]), version(two, ["u"]), version(two, ["t", "u"], "rules/2")}) == 4
    assert version(two, ["t"]) == version(one, ["t"])
    assert digests.ruleset_version(one.limit(0), ["t"], "x").first().rows == 0


def test_report_of_statistics(spark, tmp_path):
    p = spark.createDataFrame([(c, k, 1 + (c + k) % 3) for c in range(40) for k in range(6) if (c * k) % 4 != 1], "card_id long, concept_id long, local_count long")
    version = lambda f, **a: stats.stats_version(f, **a).first().version
    assert version(p) == version(p.repartition(5).orderBy(F.desc("concept_id"))) != version(p.where("card_id > 0"))
    assert version(p) != version(p, k_cooc=5)
    stats.write_report(stats.report(p), str(tmp_path / "report"))
    lines = [x for f in sorted((tmp_path / "report").glob("part-*")) for x in f.read_text().splitlines()]
    assert version(p) in lines[0] and '"N":40' in lines[0]
    kept = stats.cooccurrence(p).where("outcome = 'kept'").count()
    assert len(lines) == 1 + kept + p.count()
