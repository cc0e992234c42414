"""Property test: the Spark text parser and its DuckDB statement agree on
arbitrary lines built from a small alphabet."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seedgrow.functions import as_array
from seedgrow.sources import parse_labeled_lines

ALPHABET = "0123456789-, x."

DUCK = """
WITH lines AS (SELECT unnest($lines) AS value),
p1 AS (SELECT value, strpos(value, ',') AS comma, split_part(value, ',', 1) AS label_txt FROM lines),
p2 AS (SELECT *, CASE WHEN comma > 0 THEN regexp_replace(split_part(substr(value, comma + 1), ',', 1), ' +$', '') END AS feats FROM p1),
p3 AS (SELECT *, TRY_CAST(trim(label_txt) AS DOUBLE) AS label, string_split(feats, ' ') AS tokens FROM p2),
p4 AS (SELECT *, [TRY_CAST(x AS DOUBLE) for x in tokens] AS vals FROM p3)
SELECT value, CASE WHEN comma = 0 THEN 'no_comma' WHEN label IS NULL THEN 'bad_label'
  WHEN length(feats) = 0 THEN 'no_features' WHEN list_contains(tokens, '') THEN 'blank_field'
  WHEN len([x for x in vals if x IS NULL]) > 0 THEN 'not_a_number' END AS reason,
  CASE WHEN reason IS NULL THEN label END AS label, CASE WHEN reason IS NULL THEN vals END AS vals FROM p4
"""


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, min_size=0, max_size=14), min_size=1, max_size=40))
def test_parser_matches_sql(spark, lines):
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    got = sorted(
        (r["line"], r["reject_reason"], r["label"], None if r["f"] is None else tuple(r["f"]))
        for r in parse_labeled_lines(df, keep_line=True)
        .select("line", "reject_reason", "label", as_array("features").alias("f"))
        .collect()
    )
    want = sorted(
        (v, reason, label, None if vals is None else tuple(vals))
        for v, reason, label, vals in duckdb.execute(DUCK, {"lines": lines}).fetchall()
    )
    assert got == want
