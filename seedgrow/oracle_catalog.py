"""DuckDB statements matching ``seedgrow.workloads.QUERIES`` key by key.

Rows-only keys (random forest, logistic regression) have no statement.
"""

from __future__ import annotations

from seedgrow import oracle as O
from seedgrow import workloads as W
from seedgrow.functions.hashing import unit_hash_sql
from seedgrow.sources.tables import LETTERS

ROWS = O.embeddings_rows(W.FRACTION, W.SEED)
BIN_ROWS = O.embeddings_rows(W.FRACTION, W.SEED, binary=True)
V1 = list(range(32))
V2 = list(range(32, 64))


def _letters(text: str) -> str:
    t = f"lower({text})"
    parts = [
        f"CASE WHEN length({t}) > 0 THEN (length({t}) - length(replace({t}, '{c}', ''))) / length({t}) ELSE 0.0 END"
        for c in LETTERS
    ]
    return "[" + ", ".join(parts) + "]::DOUBLE[]"


LANG_INDEX = (
    "SELECT lang, CAST(row_number() OVER (ORDER BY count(*) DESC, lang ASC) - 1 AS DOUBLE) AS i "
    "FROM documents WHERE lang IS NOT NULL GROUP BY lang"
)


def _doc_rows(label: str = "idx.i") -> str:
    h = unit_hash_sql("d.doc_id", W.SEED)
    return (
        f"SELECT d.doc_id AS id, {label} AS t, CASE WHEN {h} < {W.FRACTION} THEN {label} END AS y, "
        f"{_letters('d.text')} AS v FROM documents d LEFT JOIN ({LANG_INDEX}) idx ON idx.lang = d.lang"
    )


def _dup_rows() -> str:
    """Seed rows plus the duplicated pool (labels hidden)."""
    h = unit_hash_sql("vec_id", W.DUP_SEED)
    return (
        f"SELECT id, t, y, v FROM ({ROWS}) r UNION ALL "
        f"SELECT vec_id + {W.DUP_ID_OFFSET} AS id, CAST(label AS DOUBLE) AS t, NULL::DOUBLE AS y, "
        f"CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {h} < {W.DUP_FRACTION}"
    )


def _scored(w: O.With, model: str, rel: str, name: str) -> str:
    O.gnb_score(w, name, model, rel)
    return f"SELECT id AS row_id, CAST(pred AS DOUBLE) AS prediction, round(conf, 6) AS confidence FROM {name}"


# ------------------------------------------------------------------ text

def _part_lines() -> str:
    return """
SELECT CASE
  WHEN p_type = 'ECONOMY' AND p_name LIKE '%gear' THEN concat_ws(' ', lab, f1, f2, f3)
  WHEN p_type = 'ECONOMY' AND p_name LIKE '%bolt' THEN lab || ',' || f1 || '  ' || f2 || ' ' || f3
  WHEN p_type = 'PROMO' AND p_name LIKE '%ring' THEN lab || ',' || 'x' || f1 || ' ' || f2 || ' ' || f3
  WHEN p_type = 'SMALL' AND p_name LIKE '%rod' THEN lab || ',' || f1 || ' ' || f2 || ' ' || f3 || ' '
  WHEN p_type = 'LARGE' AND p_name LIKE '%bolt' THEN 'y' || ',' || f1 || ' ' || f2 || ' ' || f3
  WHEN p_type = 'STANDARD' AND p_name LIKE '%anvil' THEN lab || ','
  ELSE lab || ',' || f1 || ' ' || f2 || ' ' || f3 END AS value
FROM (SELECT p_type, p_name, CASE WHEN p_size > 25 THEN '1' ELSE '-1' END AS lab, CAST(p_size AS VARCHAR) AS f1,
             CAST(length(p_name) AS VARCHAR) AS f2, CAST(p_partkey AS VARCHAR) AS f3 FROM part) q"""


def _parsed() -> str:
    return f"""
WITH lines AS ({_part_lines()}),
p1 AS (SELECT value, strpos(value, ',') AS comma, split_part(value, ',', 1) AS label_txt FROM lines),
p2 AS (SELECT *, CASE WHEN comma > 0 THEN regexp_replace(split_part(substr(value, comma + 1), ',', 1), ' +$', '') END AS feats FROM p1),
p3 AS (SELECT *, TRY_CAST(trim(label_txt) AS DOUBLE) AS label, string_split(feats, ' ') AS tokens FROM p2),
p4 AS (SELECT *, [TRY_CAST(x AS DOUBLE) for x in tokens] AS vals FROM p3),
p5 AS (SELECT *, CASE WHEN comma = 0 THEN 'no_comma' WHEN label IS NULL THEN 'bad_label'
  WHEN length(feats) = 0 THEN 'no_features' WHEN list_contains(tokens, '') THEN 'blank_field'
  WHEN len([x for x in vals if x IS NULL]) > 0 THEN 'not_a_number' END AS reason FROM p4)
"""


def labeled_text_parse() -> str:
    return _parsed() + (
        "SELECT value AS line, label, CAST(len(vals) AS INTEGER) AS n_features, list_sum(vals) AS f_sum, "
        "vals[1] AS f_first, vals[-1] AS f_last FROM p5 WHERE reason IS NULL"
    )


def labeled_text_rejects() -> str:
    return _parsed() + "SELECT reason AS reject_reason, count(*) AS n_lines FROM p5 WHERE reason IS NOT NULL GROUP BY reason"


# ------------------------------------------------------------------ projections

def hide_labels() -> str:
    return f"SELECT id AS row_id, NULL::DOUBLE AS label, len(v) AS dims FROM ({ROWS}) r WHERE y IS NULL"


def mark_unlabeled() -> str:
    return f"SELECT id AS row_id, y AS label FROM ({ROWS}) r"


def mixed_features() -> str:
    return f"SELECT id AS row_id, len(v) AS dims, round(list_sum(v), 6) AS f_sum FROM ({ROWS}) r"


def feature_count() -> str:
    return "SELECT count(*) AS n_rows, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings"


def class_partition() -> str:
    return (
        f"SELECT id AS row_id, t AS label, CASE WHEN t = 1.0 THEN 'positive' ELSE 'negative' END AS part "
        f"FROM ({BIN_ROWS}) r"
    )


def label_index() -> str:
    return (
        "SELECT lang AS label, CAST(row_number() OVER (ORDER BY count(*) DESC, lang ASC) - 1 AS DOUBLE) AS label_index, "
        "count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang"
    )


def label_roundtrip() -> str:
    return (
        f"SELECT d.doc_id AS row_id, d.lang AS label, idx.i AS label_index, idx.lang AS label_back "
        f"FROM documents d LEFT JOIN ({LANG_INDEX}) idx ON idx.lang = d.lang"
    )


# ------------------------------------------------------------------ splits

def stratified_split() -> str:
    h = unit_hash_sql("id", W.SEED)
    return (
        f"SELECT t AS label, {h} < {W.HOLDOUT_FRACTION} AS is_labeled, count(*) AS n "
        f"FROM ({BIN_ROWS}) r GROUP BY ALL"
    )


def repeated_holdout() -> str:
    seeds = ", ".join(str(s) for s in W.HOLDOUT_SEEDS)
    u = "(('0x' || substr(md5(CAST(fold_seed AS VARCHAR) || ':' || CAST(id AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0)"
    return (
        f"SELECT fold_seed, label, {u} < {W.HOLDOUT_FRACTION} AS is_labeled, count(*) AS n FROM "
        f"(SELECT id, t AS label, CAST(unnest([{seeds}]) AS INTEGER) AS fold_seed FROM ({BIN_ROWS}) r) q GROUP BY ALL"
    )


# ------------------------------------------------------------------ views

def feature_view_slice() -> str:
    cols = ", ".join(f"round(v[{i + 1}], 6) AS x{k}" for k, i in enumerate(W.SLICE_VIEW))
    return f"SELECT id AS row_id, {cols} FROM ({ROWS}) r"


def feature_view_default() -> str:
    return (
        "SELECT id AS row_id, CAST(len(v[1:32]) AS INTEGER) AS dim1, CAST(len(v[33:64]) AS INTEGER) AS dim2, "
        f"round(list_sum(v[1:32]), 6) AS sum1, round(list_sum(v[33:64]), 6) AS sum2 FROM ({ROWS}) r"
    )


def view_scoring() -> str:
    w = O.With()
    O.add_source(w, ROWS, False)
    m = O.gnb_fit(w, "m", f"(SELECT y, {O.view_expr('v', V1)} AS v FROM seed)")
    O.gnb_score(w, "s", m, f"(SELECT id, {O.view_expr('v', V1)} AS v FROM pool0)")
    return w.sql(
        f"SELECT s.id AS row_id, CAST(s.pred AS DOUBLE) AS label, len(p.v) AS dims FROM s JOIN pool0 p ON p.id = s.id "
        f"WHERE s.conf > {W.CT_THRESHOLD}"
    )


# ------------------------------------------------------------------ base learner, pseudo-labels

def _seed_scored(extra: str) -> str:
    w = O.With()
    O.add_source(w, ROWS, False)
    m = O.gnb_fit(w, "m", "(SELECT y, v FROM seed)")
    O.gnb_score(w, "s", m, "pool0")
    return w.sql(extra)


def base_learner_fit() -> str:
    w = O.With()
    O.add_source(w, ROWS, False)
    m = O.gnb_fit(w, "m", "(SELECT y, v FROM seed)")
    return w.sql(
        "SELECT s.y AS label, CAST(s.j AS INTEGER) AS j, round(s.mu, 6) AS mu, round(s.s2, 6) AS var, "
        "round(p.lp, 6) AS log_prior FROM m_stat s JOIN m_pri p ON p.y = s.y"
    )


def base_learner_predict() -> str:
    return _seed_scored("SELECT id AS row_id, CAST(pred AS DOUBLE) AS prediction, round(conf, 6) AS confidence FROM s")


def supervised_nb() -> str:
    w = O.With()
    O.add_source(w, _doc_rows(), False)
    m = O.gnb_fit(w, "m", "(SELECT y, v FROM seed)")
    return w.sql(_scored(w, m, "(SELECT id, v FROM src)", "s"))


def confidence_filter() -> str:
    return _seed_scored(
        f"SELECT id AS row_id, CAST(pred AS DOUBLE) AS prediction, round(conf, 6) AS confidence FROM s "
        f"WHERE conf > {W.ST_THRESHOLD}"
    )


def reliable_pseudo_labels() -> str:
    return _seed_scored(f"SELECT id AS row_id, CAST(pred AS DOUBLE) AS label FROM s WHERE conf > {W.ST_THRESHOLD}")


def pseudo_label_all() -> str:
    return _seed_scored("SELECT id AS row_id, CAST(pred AS DOUBLE) AS label FROM s")


def grow_labeled() -> str:
    return _seed_scored(
        f"SELECT id AS row_id, y AS label FROM seed UNION ALL "
        f"SELECT id AS row_id, CAST(pred AS DOUBLE) AS label FROM s WHERE conf > {W.ST_THRESHOLD}"
    )


def mix_labeled_predicted() -> str:
    return _seed_scored(
        "SELECT id AS row_id, y AS label FROM seed UNION ALL SELECT id AS row_id, CAST(pred AS DOUBLE) AS label FROM s"
    )


def _dup_scored(extra: str) -> str:
    w = O.With()
    O.add_source(w, _dup_rows(), True)
    m = O.gnb_fit(w, "m", "(SELECT y, v FROM seed)")
    O.gnb_score(w, "s", m, "pool0")
    w.add("acc", f"SELECT p.id, p.v FROM pool0 p JOIN s ON s.id = p.id WHERE s.conf > {W.ST_THRESHOLD}")
    return w.sql(extra)


def pool_except() -> str:
    return _dup_scored(
        "SELECT min(id) AS row_id FROM pool0 WHERE v NOT IN (SELECT v FROM acc) GROUP BY v"
    )


def pool_anti_by_id() -> str:
    return _dup_scored("SELECT id AS row_id FROM pool0 WHERE id NOT IN (SELECT id FROM acc)")


def duplicate_summary() -> str:
    return (
        f"SELECT count(*) AS n_rows, count(DISTINCT v) AS n_distinct FROM ({_dup_rows()}) r WHERE y IS NULL"
    )


def _exchange(w: O.With) -> None:
    O.add_source(w, ROWS, True)
    for name, view in (("a", V1), ("b", V2)):
        m = O.gnb_fit(w, f"m{name}", f"(SELECT y, {O.view_expr('v', view)} AS v FROM seed)")
        O.gnb_score(w, f"s{name}", m, f"(SELECT id, {O.view_expr('v', view)} AS v FROM pool0)")
        w.add(
            f"n{name}",
            f"SELECT p.id, CAST(s.pred AS DOUBLE) AS y, p.v FROM pool0 p JOIN s{name} s ON s.id = p.id "
            f"WHERE s.conf > {W.CT_THRESHOLD}",
        )
    w.add("l1", "SELECT id, y, v FROM seed UNION ALL SELECT id, y, v FROM nb")
    w.add("l2", "SELECT id, y, v FROM seed UNION ALL SELECT id, y, v FROM na")
    w.add("u1", "SELECT min(id) AS id FROM pool0 WHERE v NOT IN (SELECT v FROM na) GROUP BY v")
    w.add("u2", "SELECT min(id) AS id FROM pool0 WHERE v NOT IN (SELECT v FROM nb) GROUP BY v")


def cross_teach() -> str:
    w = O.With()
    _exchange(w)
    return w.sql(
        "SELECT 'labeled1' AS table_name, id AS row_id, y AS label FROM l1 UNION ALL "
        "SELECT 'labeled2', id, y FROM l2 UNION ALL "
        "SELECT 'unlabeled1', id, NULL::DOUBLE FROM u1 UNION ALL "
        "SELECT 'unlabeled2', id, NULL::DOUBLE FROM u2"
    )


def agreement_intersect() -> str:
    w = O.With()
    _exchange(w)
    return w.sql(
        "SELECT y AS label, round(list_sum(v), 6) AS f_sum FROM (SELECT y, v FROM l1 INTERSECT SELECT y, v FROM l2) q"
    )


# ------------------------------------------------------------------ loops

ST_SELECT = "SELECT iteration, n_labeled, n_unlabeled, n_new FROM {h}"
CT_SELECT = (
    "SELECT iteration, n_new1, n_new2, n_labeled1, n_labeled2, n_unlabeled1, n_unlabeled2, n_agreement FROM {h}"
)


def _st(rows: str = ROWS, dedup: bool = True) -> tuple[O.With, str, str]:
    w = O.With()
    O.add_source(w, rows, dedup)
    h, f = O.selftraining(w, W.ST_THRESHOLD, W.ST_ITERS, dedup)
    return w, h, f


def selftraining_history() -> str:
    w, h, _ = _st()
    return w.sql(ST_SELECT.format(h=h))


def selftraining_predict() -> str:
    w, _, f = _st()
    return w.sql(_scored(w, f, "(SELECT id, v FROM src)", "fin"))


def selftraining_dedup_history() -> str:
    w, h, _ = _st(_dup_rows(), True)
    return w.sql(ST_SELECT.format(h=h))


def selftraining_id_history() -> str:
    w, h, _ = _st(_dup_rows(), False)
    return w.sql(ST_SELECT.format(h=h))


def _em() -> tuple[O.With, str, str, str]:
    w = O.With()
    O.add_source(w, ROWS, False)
    h, f, t = O.hard_em(w, W.EM_ITERS)
    return w, h, f, t


def em_history() -> str:
    w, h, _, _ = _em()
    return w.sql(f"SELECT iteration, round(residual_pct, 6) AS residual_pct, n_changed, n_labeled, n_unlabeled FROM {h}")


def em_tolerance_history() -> str:
    w = O.With()
    O.add_source(w, ROWS, False)
    h, _, _ = O.hard_em(w, W.HARNESS_EM_ITERS, "", W.HARNESS_EM_TOL)
    return w.sql(f"SELECT iteration, round(residual_pct, 6) AS residual_pct, n_changed, n_labeled, n_unlabeled FROM {h}")


def em_predict() -> str:
    w, _, f, _ = _em()
    return w.sql(_scored(w, f, "(SELECT id, v FROM src)", "fin"))


def em_final_training_set() -> str:
    w, _, _, t = _em()
    return w.sql(f"SELECT id AS row_id, CAST(y AS DOUBLE) AS label FROM {t}")


def label_residual() -> str:
    w = O.With()
    O.add_source(w, ROWS, False)
    m0 = O.gnb_fit(w, "m0", "(SELECT y, v FROM seed)")
    O.gnb_score(w, "s0", m0, "pool0")
    m1 = O.gnb_fit(w, "m1", "(SELECT y, v FROM seed UNION ALL SELECT s.pred AS y, p.v FROM pool0 p JOIN s0 s ON s.id = p.id)")
    O.gnb_score(w, "s1", m1, "pool0")
    return w.sql(
        "SELECT round(100.0 * avg(CASE WHEN a.pred <> b.pred THEN 1.0 ELSE 0.0 END), 6) AS residual_pct, "
        "CAST(sum(CASE WHEN a.pred <> b.pred THEN 1 ELSE 0 END) AS BIGINT) AS n_changed, count(*) AS n "
        "FROM s0 a JOIN s1 b ON a.id = b.id"
    )


def _ct(v1=V1, v2=V2) -> tuple[O.With, str, str]:
    w = O.With()
    O.add_source(w, ROWS, True)
    h, f = O.cotraining(w, W.CT_THRESHOLD, W.CT_ITERS, v1, v2, True)
    return w, h, f


def cotraining_history() -> str:
    w, h, _ = _ct()
    return w.sql(CT_SELECT.format(h=h))


def cotraining_predict() -> str:
    w, _, f = _ct()
    return w.sql(_scored(w, f, "(SELECT id, v FROM src)", "fin"))


def cotraining_custom_views() -> str:
    w, h, _ = _ct(W.CUSTOM_VIEW1, W.CUSTOM_VIEW2)
    return w.sql(CT_SELECT.format(h=h))


# ------------------------------------------------------------------ metrics

def _quality(w: O.With) -> None:
    h = unit_hash_sql("d.doc_id", W.METRIC_SEED)
    w.add(
        "q",
        f"SELECT d.doc_id AS id, CAST(l.quality AS DOUBLE) AS t, {h} < {W.METRIC_FRACTION} AS is_train, "
        f"{_letters('d.text')} AS v FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL",
    )
    m = O.gnb_fit(w, "qm", "(SELECT t AS y, v FROM q WHERE is_train)")
    O.gnb_score(w, "qs", m, "(SELECT id, v FROM q WHERE NOT is_train)", pos=1.0)
    w.add("r", "SELECT q.t AS label, CAST(s.pred AS DOUBLE) AS prediction, round(s.ppos, 12) AS score FROM q JOIN qs s ON s.id = q.id")


def weighted_sql(rel: str) -> str:
    """One row of weighted metrics over ``rel(label, prediction)``."""
    return f"""
SELECT sum(p * n_true) / sum(n_true) AS weighted_precision, sum(r * n_true) / sum(n_true) AS weighted_recall,
       sum(f1 * n_true) / sum(n_true) AS weighted_f1, sum(tp) / sum(n_true) AS accuracy, CAST(sum(n_true) AS BIGINT) AS n
FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM (
  SELECT t.n_true, t.tp, CASE WHEN coalesce(pp.n_pred, 0) > 0 THEN t.tp / pp.n_pred ELSE 0.0 END AS p, t.tp / t.n_true AS r
  FROM (SELECT label, sum(n) AS n_true, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp
        FROM (SELECT label, prediction, count(*) AS n FROM {rel} GROUP BY ALL) c GROUP BY label) t
  LEFT JOIN (SELECT prediction AS label, count(*) AS n_pred FROM {rel} GROUP BY prediction) pp ON pp.label = t.label) a) b"""


def auc_sql(rel: str, pos: float = 1.0) -> str:
    """``(auc, auc_folded, n_pos, n_neg)`` over ``rel(label, score)``."""
    return f"""
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT score, sum(CASE WHEN label = {pos} THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = {pos} THEN 0 ELSE 1 END) AS neg
            FROM {rel} WHERE score IS NOT NULL GROUP BY score) g) c"""


def roc_sql(rel: str, pos: float = 1.0) -> str:
    return f"""
SELECT score AS threshold, round((n_neg - neg_below) / n_neg, 9) AS fpr, round((n_pos - pos_below) / n_pos, 9) AS tpr
FROM (SELECT score,
        coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
        coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
        sum(neg) OVER () AS n_neg, sum(pos) OVER () AS n_pos
      FROM (SELECT score, sum(CASE WHEN label = {pos} THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = {pos} THEN 0 ELSE 1 END) AS neg
            FROM {rel} WHERE score IS NOT NULL GROUP BY score) g) c
UNION ALL SELECT NULL::DOUBLE, 0.0, 0.0 UNION ALL SELECT NULL::DOUBLE, 1.0, 1.0"""


def confusion_matrix() -> str:
    w = O.With()
    _quality(w)
    return w.sql("SELECT label, prediction, count(*) AS n FROM r GROUP BY ALL")


def weighted_metrics() -> str:
    w = O.With()
    _quality(w)
    return w.sql(
        "SELECT round(weighted_precision, 6) AS weighted_precision, round(weighted_recall, 6) AS weighted_recall, "
        f"round(weighted_f1, 6) AS weighted_f1, round(accuracy, 6) AS accuracy, n FROM ({weighted_sql('r')}) x"
    )


def auc_roc() -> str:
    w = O.With()
    _quality(w)
    return w.sql(
        "SELECT round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS auc_folded, n_pos, n_neg "
        f"FROM ({auc_sql('r')}) x"
    )


def roc_curve() -> str:
    w = O.With()
    _quality(w)
    return w.sql(roc_sql("r"))


# ------------------------------------------------------------------ harness

def _binary_rows(fraction: float, seed: int) -> str:
    return O.embeddings_rows(fraction, seed, binary=True)


def _harness_run(frac, seed) -> str:
    """The metrics of all algorithms at one fraction and fold. A statement of
    its own, as the engine limits the depth of one WITH list."""
    w = O.With()
    longs = []
    O.add_source(w, _binary_rows(frac, seed), True)
    sup = O.gnb_fit(w, "nb", "(SELECT y, v FROM seed)")
    models = [
        (sup, "NaiveBayes"),
        (O.selftraining(w, W.ST_THRESHOLD, W.HARNESS_ST_ITERS, True)[1], "SelfTraining"),
        (O.hard_em(w, W.HARNESS_EM_ITERS, "", W.HARNESS_EM_TOL)[1], "EM"),
        (O.cotraining(w, W.CT_THRESHOLD, W.CT_ITERS, V1, V2, True)[1], "CoTraining"),
    ]
    for model, name in models:
        s = O.gnb_score(w, f"{name}_s", model, "pool0", pos=1.0)
        r = w.add(
            f"{name}_r",
            f"SELECT src.t AS label, CAST(s.pred AS DOUBLE) AS prediction, round(s.ppos, 12) AS score "
            f"FROM {s} s JOIN src ON src.id = s.id",
        )
        wm = w.add(f"{name}_wm", weighted_sql(r))
        au = w.add(f"{name}_au", auc_sql(r))
        longs.append(
            f"SELECT '{name}' AS name, CAST({float(frac)} AS DOUBLE) AS label_fraction, "
            f"(SELECT weighted_precision FROM {wm}) AS weighted_precision, "
            f"(SELECT weighted_recall FROM {wm}) AS weighted_recall, "
            f"(SELECT weighted_f1 FROM {wm}) AS weighted_f1, (SELECT auc FROM {au}) AS auc, "
            f"(SELECT greatest(auc, 1 - auc) FROM {au}) AS auc_folded"
        )
    return w.sql(" UNION ALL ".join(longs))


def _harness(fractions, seeds) -> str:
    runs = " UNION ALL ".join(f"SELECT * FROM ({_harness_run(f, s)})" for f in fractions for s in seeds)
    return (
        "SELECT name, label_fraction, round(avg(weighted_precision), 6) AS weighted_precision, "
        "round(avg(weighted_recall), 6) AS weighted_recall, round(avg(weighted_f1), 6) AS weighted_f1, "
        f"round(avg(auc), 6) AS auc, round(avg(auc_folded), 6) AS auc_folded FROM ({runs}) runs GROUP BY name, label_fraction"
    )


def evaluate_all_metrics() -> str:
    return _harness([W.HARNESS_FRACTION], W.HARNESS_FOLDS)


def fraction_sweep() -> str:
    return _harness(W.SWEEP_FRACTIONS, [W.SEED])


def roc_evaluation() -> str:
    w = O.With()
    p = "e_"
    O.add_source(w, _binary_rows(W.HARNESS_FRACTION, W.SEED), True, p)
    _, stf = O.selftraining(w, W.ST_THRESHOLD, W.HARNESS_ST_ITERS, True, p)
    s = O.gnb_score(w, f"{p}fs", stf, f"{p}pool0", pos=1.0)
    w.add("r", f"SELECT src.t AS label, round(s.ppos, 12) AS score FROM {s} s JOIN {p}src src ON src.id = s.id")
    return w.sql(roc_sql("r"))


def pipeline_compose() -> str:
    w = O.With()
    h = unit_hash_sql("doc_id", W.SEED)
    rows = (
        f"SELECT doc_id AS id, lang AS t, CASE WHEN {h} < {W.FRACTION} THEN lang END AS y, {_letters('text')} AS v "
        f"FROM documents"
    )
    O.add_source(w, rows, True)
    _, f = O.selftraining(w, W.DOC_THRESHOLD, W.DOC_ITERS, True)
    O.gnb_score(w, "fin", f, "(SELECT id, v FROM src)")
    return w.sql("SELECT id AS row_id, pred AS predicted_lang FROM fin")


def _mnb_fit(w: O.With, name: str, rel: str) -> str:
    """Multinomial naive Bayes (smoothing 1): ``(y, j, theta, pi)``."""
    w.add(f"{name}_n", f"SELECT y, CAST(count(*) AS DOUBLE) AS n FROM {rel} q GROUP BY y")
    w.add(f"{name}_s", f"SELECT y, j, sum(v[j]) AS s FROM {rel} q, range(1, {len(LETTERS) + 1}) t(j) GROUP BY y, j")
    return w.add(
        name,
        f"SELECT s.y, j, ln(s + 1.0) - ln(sum(s) OVER (PARTITION BY s.y) + {len(LETTERS)}.0) AS theta, "
        f"ln(n + 1.0) - ln((SELECT sum(n) + count(*) FROM {name}_n)) AS pi "
        f"FROM {name}_s s JOIN {name}_n c ON c.y = s.y",
    )


def _mnb_score(w: O.With, name: str, model: str, rel: str) -> str:
    """``(id, pred, conf)`` of every row of ``rel(id, v)``."""
    w.add(f"{name}_r", f"SELECT id, y, any_value(pi) + sum(theta * v[j]) AS r FROM {rel} q, {model} GROUP BY id, y")
    w.add(f"{name}_e", f"SELECT id, y, exp(r - max(r) OVER (PARTITION BY id)) AS e FROM {name}_r")
    return w.add(name, f"SELECT id, arg_max(y, e) AS pred, max(e) / sum(e) AS conf FROM {name}_e GROUP BY id")


def base_learner_swap() -> str:
    """The loop unrolled: each pass fits on the seed and all rows accepted so
    far, and accepts confident rows still in the pool; a last fit on all."""
    w = O.With()
    w.add("src", f"SELECT id, t, y, list_transform(v, lambda x : x * 100) AS v FROM ({_doc_rows()}) d")
    w.add("acc0", "SELECT id, y FROM src WHERE false")
    train = "(SELECT y, v FROM src WHERE y IS NOT NULL UNION ALL SELECT a.y, src.v FROM src JOIN acc{k} a ON a.id = src.id)"
    for k in range(W.SWAP_ITERS):
        m = _mnb_fit(w, f"m{k}", train.format(k=k))
        _mnb_score(w, f"s{k}", m, f"(SELECT id, v FROM src WHERE y IS NULL AND id NOT IN (SELECT id FROM acc{k}))")
        w.add(f"acc{k + 1}", f"SELECT id, y FROM acc{k} UNION ALL SELECT id, pred AS y FROM s{k} WHERE conf > {W.SWAP_THRESHOLD}")
    m = _mnb_fit(w, "last", train.format(k=W.SWAP_ITERS))
    _mnb_score(w, "fin", m, "(SELECT id, v FROM src)")
    return w.sql("SELECT id AS row_id, CAST(pred AS DOUBLE) AS prediction, round(conf, 6) AS confidence FROM fin")


def custom_columns() -> str:
    return selftraining_predict()


def roc_one_class() -> str:
    return """
    SELECT round(CAST(quality AS DOUBLE) / 2, 6) AS threshold, NULL::DOUBLE AS fpr,
      round(sum(count(*)) OVER (ORDER BY quality DESC) / sum(count(*)) OVER (), 9) AS tpr
    FROM labels WHERE quality IS NOT NULL GROUP BY quality
    UNION ALL SELECT NULL, 0.0, 0.0 UNION ALL SELECT NULL, 1.0, 1.0"""


def text_file_round_trip() -> str:
    return labeled_text_parse()


def results_read_back() -> str:
    return _harness([W.HARNESS_FRACTION], [W.SEED])


def overwrite_read_back() -> str:
    return "SELECT lang AS name, count(*) * 10 AS n FROM documents WHERE lang <> 'en' GROUP BY lang"


def roc_read_back() -> str:
    return roc_curve()


SQL = {
    "base_learner_swap": base_learner_swap,
    "roc_one_class": roc_one_class,
    "text_file_round_trip": text_file_round_trip,
    "results_read_back": results_read_back,
    "overwrite_read_back": overwrite_read_back,
    "roc_read_back": roc_read_back,
    "custom_columns": custom_columns,
    "labeled_text_parse": labeled_text_parse,
    "labeled_text_rejects": labeled_text_rejects,
    "hide_labels": hide_labels,
    "mark_unlabeled": mark_unlabeled,
    "mixed_features": mixed_features,
    "feature_count": feature_count,
    "class_partition": class_partition,
    "label_index": label_index,
    "label_roundtrip": label_roundtrip,
    "stratified_split": stratified_split,
    "repeated_holdout": repeated_holdout,
    "feature_view_slice": feature_view_slice,
    "feature_view_default": feature_view_default,
    "view_scoring": view_scoring,
    "base_learner_fit": base_learner_fit,
    "base_learner_predict": base_learner_predict,
    "supervised_nb": supervised_nb,
    "confidence_filter": confidence_filter,
    "reliable_pseudo_labels": reliable_pseudo_labels,
    "pseudo_label_all": pseudo_label_all,
    "grow_labeled": grow_labeled,
    "mix_labeled_predicted": mix_labeled_predicted,
    "pool_except": pool_except,
    "pool_anti_by_id": pool_anti_by_id,
    "cross_teach": cross_teach,
    "agreement_intersect": agreement_intersect,
    "duplicate_summary": duplicate_summary,
    "selftraining_history": selftraining_history,
    "selftraining_predict": selftraining_predict,
    "selftraining_dedup_history": selftraining_dedup_history,
    "selftraining_id_history": selftraining_id_history,
    "em_history": em_history,
    "em_tolerance_history": em_tolerance_history,
    "em_predict": em_predict,
    "em_final_training_set": em_final_training_set,
    "label_residual": label_residual,
    "cotraining_history": cotraining_history,
    "cotraining_predict": cotraining_predict,
    "cotraining_custom_views": cotraining_custom_views,
    "confusion_matrix": confusion_matrix,
    "weighted_metrics": weighted_metrics,
    "auc_roc": auc_roc,
    "roc_curve": roc_curve,
    "roc_evaluation": roc_evaluation,
    "pipeline_compose": pipeline_compose,
    "evaluate_all_metrics": evaluate_all_metrics,
    "fraction_sweep": fraction_sweep,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in SQL.items()}
