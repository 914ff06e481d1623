from quire.functions import sql


def test_functions_of_a_session(spark):
    sql.register(spark)
    sql.register(spark)  # again: replaced
    r = spark.sql("SELECT callout_type('TIP: **x**') a, callout_type(NULL) b, callout_type(' ') c, is_stopping_point(NULL) d, paragraph_class('do _this_', true) e, heading_level('REAGENTS', NULL) f, section_role(' Procedure ') g, content_hash(NULL) h, squeeze(NULL) i, heading_level('x', 'Heading 3') j").first()
    assert tuple(r) == ("tip", None, None, None, "step", 2, "procedure", None, "", 3)
    assert spark.sql("SELECT x.* FROM (SELECT lines_of(NULL) AS of), LATERAL inline(of) x").collect() == [] and [tuple(r) for r in spark.sql("SELECT x.* FROM (SELECT lines_of('a\\n\\n b ') AS of), LATERAL inline(of) x").collect()] == [(0, "a"), (2, "b")]
    assert [r.cell for r in spark.sql("SELECT cell FROM (SELECT cells_of('x | y  z | ') AS of), LATERAL inline(of)").collect()] == ["x", "y z", ""]
    assert "Python" not in spark.sql("SELECT callout_type('a')")._jdf.queryExecution().executedPlan().toString()
