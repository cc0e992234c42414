"""DuckDB SQL builders for the correctness oracle (tests and the driver's
check only; the engine never runs SQL text).

The loop oracles unroll a fixed number of iterations as materialised CTEs
and use Gaussian naive Bayes, whose fit is closed-form:

* ``eps = 1e-9 * max_j var_pop(x_j)`` over the whole training set;
* per class and position: mean and ``var_pop + eps``;
* log prior ``ln(n_y / n)``;
* ``ll(y) = prior + sum_j -0.5 ln(2 pi s2) - (x - mu)^2 / (2 s2)``;
* prediction ``argmax ll``, confidence ``1 / sum_y exp(ll_y - max ll)``.

Relations passed around have columns ``(id, y, v)``: a row id, a label
(null in the pool) and the feature list ``DOUBLE[]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from seedgrow.functions.hashing import unit_hash_sql


class With:
    """An ordered list of CTEs rendered as one statement."""

    def __init__(self) -> None:
        self.ctes: list[str] = []
        self.names: set[str] = set()

    def add(self, name: str, body: str, materialized: bool = True) -> str:
        if name in self.names:
            raise ValueError(f"duplicate CTE {name}")
        self.names.add(name)
        self.ctes.append(f"{name} AS {'MATERIALIZED ' if materialized else ''}(\n{body}\n)")
        return name

    def sql(self, final: str) -> str:
        return "WITH " + ",\n".join(self.ctes) + "\n" + final


def view_expr(v: str, indices: Sequence[int] | None) -> str:
    if indices is None:
        return v
    lst = ", ".join(str(int(i)) for i in indices)
    return f"[{v}[i + 1] for i in [{lst}]]"


def gnb_fit(w: With, name: str, train: str) -> str:
    """Fit on relation ``train(y, v)``; returns the model prefix."""
    w.add(f"{name}_x", f"SELECT y, unnest(v) AS x, unnest(range(len(v))) AS j FROM {train}")
    w.add(f"{name}_eps", f"SELECT 1e-9 * max(s) AS eps FROM (SELECT var_pop(x) AS s FROM {name}_x GROUP BY j) q")
    w.add(
        f"{name}_stat",
        f"SELECT y, j, avg(x) AS mu, var_pop(x) + (SELECT eps FROM {name}_eps) AS s2 FROM {name}_x GROUP BY y, j",
    )
    w.add(
        f"{name}_pri",
        f"SELECT y, ln(count(*) / (SELECT count(*) FROM {train})) AS lp FROM {train} GROUP BY y",
    )
    return name


def gnb_score(w: With, name: str, model: str, rel: str, pos: float | None = None) -> str:
    """Score relation ``rel(id, v)``; produces ``name(id, pred, conf[, ppos])``
    where ``ppos`` is the probability of label ``pos``."""
    w.add(f"{name}_x", f"SELECT id, unnest(v) AS x, unnest(range(len(v))) AS j FROM {rel}")
    w.add(
        f"{name}_ll",
        f"SELECT a.id, s.y, any_value(p.lp) + sum(-0.5 * ln(2 * pi() * s.s2) - (a.x - s.mu) ** 2 / (2 * s.s2)) AS ll\n"
        f"FROM {name}_x a JOIN {model}_stat s ON s.j = a.j JOIN {model}_pri p ON p.y = s.y\n"
        f"GROUP BY a.id, s.y",
    )
    w.add(
        name,
        f"SELECT id, arg_max(y, ll) AS pred, 1.0 / sum(exp(ll - mx)) AS conf"
        + (f", sum(CASE WHEN y = {pos} THEN exp(ll - mx) ELSE 0 END) / sum(exp(ll - mx)) AS ppos" if pos is not None else "")
        + f"\nFROM (SELECT id, y, ll, max(ll) OVER (PARTITION BY id) AS mx FROM {name}_ll) q GROUP BY id",
    )
    return name


# ---------------------------------------------------------------- fixtures

def embeddings_rows(fraction: float, seed: int, binary: bool = False) -> str:
    """``(id, t, y, v)``: true label ``t``; ``y`` hidden outside the seed."""
    t = "CAST(CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END AS DOUBLE)" if binary else "CAST(label AS DOUBLE)"
    h = unit_hash_sql("vec_id", seed)
    return (
        f"SELECT vec_id AS id, {t} AS t, CASE WHEN {h} < {float(fraction)} THEN {t} END AS y, "
        f"CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
    )


# ---------------------------------------------------------------- loops

def add_source(w: With, rows_sql: str, dedup: bool, p: str = "") -> None:
    """``{p}src(id, t, y, v)``, ``{p}seed(id, y, v)``, ``{p}pool0(id, v)``."""
    w.add(f"{p}src", rows_sql)
    w.add(f"{p}seed", f"SELECT id, y, v FROM {p}src WHERE y IS NOT NULL")
    w.add(f"{p}pool0", f"SELECT id, v FROM {p}src WHERE y IS NULL")
    if dedup:
        w.add(
            f"{p}pool0_first",
            f"SELECT id FROM (SELECT id, min(id) OVER (PARTITION BY v) AS rep FROM {p}src WHERE y IS NULL) q WHERE id = rep",
        )


def selftraining(w: With, threshold: float, iterations: int, dedup: bool, p: str = "",
                 view: Sequence[int] | None = None) -> tuple[str, str]:
    """Unrolled Self-Training over ``{p}seed`` / ``{p}pool0``; returns
    (history relation, final model)."""
    labeled, pool = f"{p}seed", f"{p}pool0"
    hist = []
    for k in range(1, iterations + 1):
        n = f"{p}st{k}"
        m = gnb_fit(w, n, f"(SELECT y, {view_expr('v', view)} AS v FROM {labeled})")
        s = gnb_score(w, f"{n}_s", m, f"(SELECT id, {view_expr('v', view)} AS v FROM {pool})")
        w.add(f"{n}_new", f"SELECT q.id, s.pred AS y, q.v FROM {pool} q JOIN {s} s ON s.id = q.id WHERE s.conf > {threshold}")
        keep = f"q.id NOT IN (SELECT id FROM {n}_new)"
        if dedup:
            keep += f" AND q.id IN (SELECT id FROM {p}pool0_first)"
        w.add(f"{n}_pool", f"SELECT q.id, q.v FROM {pool} q WHERE {keep}")
        w.add(f"{n}_lab", f"SELECT id, y, v FROM {labeled} UNION ALL SELECT id, y, v FROM {n}_new")
        w.add(
            f"{n}_h",
            f"SELECT {k} AS iteration, (SELECT count(*) FROM {n}_lab) AS n_labeled, "
            f"(SELECT count(*) FROM {n}_pool) AS n_unlabeled, (SELECT count(*) FROM {n}_new) AS n_new",
        )
        hist.append(f"{n}_h")
        labeled, pool = f"{n}_lab", f"{n}_pool"
    w.add(f"{p}st_hist_all", " UNION ALL ".join(f"SELECT * FROM {h}" for h in hist))
    # The loop stops after an iteration with no new rows or an empty pool.
    w.add(
        f"{p}st_hist",
        f"SELECT h.* FROM {p}st_hist_all h WHERE NOT EXISTS (SELECT 1 FROM {p}st_hist_all e "
        "WHERE e.iteration < h.iteration AND (e.n_new = 0 OR e.n_unlabeled = 0))",
    )
    final = gnb_fit(w, f"{p}stf", f"(SELECT y, {view_expr('v', view)} AS v FROM {labeled})")
    return f"{p}st_hist", final


def hard_em(w: With, iterations: int, p: str = "", tol: float | None = None) -> tuple[str, str, str]:
    """Unrolled hard EM; returns (history, final model, final training set)
    and leaves the last loop model as ``{p}em{iterations}``. With ``tol`` the
    loop ends after the first iteration whose residual is at most that."""
    model = gnb_fit(w, f"{p}em0", f"(SELECT y, v FROM {p}seed)")
    prev = None
    hist = []
    npool = f"(SELECT count(*) FROM {p}pool0)"
    for k in range(1, iterations + 1):
        s = gnb_score(w, f"{p}em{k}_s", model, f"{p}pool0")
        chg = "0" if prev is None else (
            f"(SELECT count(*) FROM {s} a JOIN {prev} b ON a.id = b.id WHERE a.pred <> b.pred)"
        )
        model = gnb_fit(
            w, f"{p}em{k}",
            f"(SELECT y, v FROM {p}seed UNION ALL SELECT s.pred AS y, q.v FROM {p}pool0 q JOIN {s} s ON s.id = q.id)",
        )
        resid = "100.0" if prev is None else f"100.0 * {chg} / {npool}"
        w.add(
            f"{p}em{k}_h",
            f"SELECT {k} AS iteration, {resid} AS residual_pct, {chg} AS n_changed, "
            f"(SELECT count(*) FROM {p}seed) AS n_labeled, {npool} AS n_unlabeled",
        )
        hist.append(f"{p}em{k}_h")
        prev = s
    w.add(f"{p}em_hist", " UNION ALL ".join(f"SELECT * FROM {h}" for h in hist))
    sf = gnb_score(w, f"{p}emf_s", model, f"{p}pool0")
    if tol is not None:
        w.add(f"{p}em_stop", f"SELECT coalesce(min(iteration) FILTER (residual_pct <= {tol}), {iterations}) AS k FROM {p}em_hist")
        w.add(f"{p}em_hist_tol", f"SELECT h.* FROM {p}em_hist h, {p}em_stop WHERE h.iteration <= k")
        after = [f"{p}em{k + 1}_s" for k in range(1, iterations)] + [sf]
        sf = w.add(
            f"{p}em_last_s",
            " UNION ALL ".join(
                f"SELECT s.id, s.pred FROM {a} s, {p}em_stop WHERE k = {k}" for k, a in enumerate(after, 1)
            ),
        )
    w.add(
        f"{p}em_final_train",
        f"SELECT id, y, v FROM {p}seed UNION ALL SELECT q.id, s.pred AS y, q.v FROM {p}pool0 q JOIN {sf} s ON s.id = q.id",
    )
    final = gnb_fit(w, f"{p}emf", f"(SELECT y, v FROM {p}em_final_train)")
    return f"{p}em_hist" if tol is None else f"{p}em_hist_tol", final, f"{p}em_final_train"


def cotraining(
    w: With, threshold: float, iterations: int, view1: Sequence[int], view2: Sequence[int], dedup: bool, p: str = ""
) -> tuple[str, str]:
    """Unrolled Co-Training; returns (history, final model)."""
    l1 = l2 = f"{p}seed"
    u1 = u2 = f"{p}pool0"
    hist = []

    def view(rel: str, idx: Sequence[int], with_y: bool) -> str:
        cols = "y, " if with_y else "id, "
        return f"(SELECT {cols}{view_expr('v', idx)} AS v FROM {rel})"

    first = f" AND q.id IN (SELECT id FROM {p}pool0_first)" if dedup else ""
    for k in range(1, iterations + 1):
        a, b = f"{p}ca{k}", f"{p}cb{k}"
        m1 = gnb_fit(w, a, view(l1, view1, True))
        m2 = gnb_fit(w, b, view(l2, view2, True))
        s1 = gnb_score(w, f"{a}_s", m1, view(u1, view1, False))
        s2 = gnb_score(w, f"{b}_s", m2, view(u2, view2, False))
        w.add(f"{a}_new", f"SELECT q.id, s.pred AS y, q.v FROM {u1} q JOIN {s1} s ON s.id = q.id WHERE s.conf > {threshold}")
        w.add(f"{b}_new", f"SELECT q.id, s.pred AS y, q.v FROM {u2} q JOIN {s2} s ON s.id = q.id WHERE s.conf > {threshold}")
        w.add(f"{a}_pool", f"SELECT q.id, q.v FROM {u1} q WHERE q.id NOT IN (SELECT id FROM {a}_new){first}")
        w.add(f"{b}_pool", f"SELECT q.id, q.v FROM {u2} q WHERE q.id NOT IN (SELECT id FROM {b}_new){first}")
        w.add(f"{a}_lab", f"SELECT id, y, v FROM {l1} UNION ALL SELECT id, y, v FROM {b}_new")
        w.add(f"{b}_lab", f"SELECT id, y, v FROM {l2} UNION ALL SELECT id, y, v FROM {a}_new")
        w.add(f"{p}c{k}_agree", f"SELECT y, v FROM {a}_lab INTERSECT SELECT y, v FROM {b}_lab")
        w.add(
            f"{p}c{k}_h",
            f"SELECT {k} AS iteration, (SELECT count(*) FROM {a}_new) AS n_new1, (SELECT count(*) FROM {b}_new) AS n_new2, "
            f"(SELECT count(*) FROM {a}_lab) AS n_labeled1, (SELECT count(*) FROM {b}_lab) AS n_labeled2, "
            f"(SELECT count(*) FROM {a}_pool) AS n_unlabeled1, (SELECT count(*) FROM {b}_pool) AS n_unlabeled2, "
            f"(SELECT count(*) FROM {p}c{k}_agree) AS n_agreement",
        )
        hist.append(f"{p}c{k}_h")
        l1, l2, u1, u2 = f"{a}_lab", f"{b}_lab", f"{a}_pool", f"{b}_pool"
    w.add(f"{p}ct_hist_all", " UNION ALL ".join(f"SELECT * FROM {h}" for h in hist))
    w.add(
        f"{p}ct_hist",
        f"SELECT h.* FROM {p}ct_hist_all h WHERE NOT EXISTS (SELECT 1 FROM {p}ct_hist_all e WHERE e.iteration < h.iteration "
        "AND (e.n_new1 + e.n_new2 = 0 OR e.n_unlabeled1 = 0 OR e.n_unlabeled2 = 0))",
    )
    final = gnb_fit(w, f"{p}ctf", f"(SELECT y, v FROM {p}c{iterations}_agree)")
    return f"{p}ct_hist", final
