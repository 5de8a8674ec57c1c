"""DuckDB SQL building blocks mirroring the Spark plans, for the correctness oracle.

Pure text builders: each function returns a CTE fragment. The SQL is an independent,
plain formulation (all-pairs joins, global windows) - fine for the sf0.01 check, not a
plan for scale.
"""

from __future__ import annotations

SEED = 42


def doc_features_sql(alias: str = "d") -> str:
    t = f"{alias}.text"
    return (f"CAST({alias}.n_chars AS DOUBLE) AS f0, "
            f"CAST(length({t}) - length(replace({t}, ' ', '')) AS DOUBLE) AS f1, "
            f"CAST(length(regexp_replace({t}, '[^0-9]', '', 'g')) AS DOUBLE) AS f2, "
            f"CAST(length({t}) - length(replace({t}, chr(10), '')) AS DOUBLE) AS f3")


def ds_sql(name: str) -> tuple[str, int]:
    """``ds(idx, label, f0..)`` CTE body and the feature width."""
    if name == "DS_DOC":
        return (f"SELECT CAST(d.doc_id AS BIGINT) AS idx, CAST(l.quality * 2 + l.toxic AS INTEGER)"
                f" AS label, {doc_features_sql()} FROM documents d JOIN labels l"
                f" ON d.doc_id = l.doc_id"), 4
    if name == "DS_LANG":
        return (f"SELECT CAST(d.doc_id AS BIGINT) AS idx, CAST(dense_rank() OVER (ORDER BY d.lang)"
                f" - 1 AS INTEGER) AS label, {doc_features_sql()} FROM documents d"), 4
    if name == "DS_EMB":
        cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64))
        return (f"SELECT CAST(vec_id AS BIGINT) AS idx, CAST(label AS INTEGER) AS label, {cols}"
                f" FROM embeddings"), 64
    if name == "DS_ORD":
        return ("SELECT CAST(o_orderkey AS BIGINT) AS idx, CAST(dense_rank() OVER"
                " (ORDER BY o_orderstatus) - 1 AS INTEGER) AS label,"
                " CAST(o_totalprice AS DOUBLE) AS f0 FROM orders"), 1
    raise ValueError(name)


def fcols(d: int, prefix: str = "") -> str:
    return ", ".join(f"{prefix}f{i}" for i in range(d))


def scaled_sql(src: str, d: int) -> str:
    """``rng`` + scaled rows from CTE ``src``; returns the two CTE definitions."""
    mm = ", ".join(f"min(f{i}) AS lo{i}, max(f{i}) AS hi{i}" for i in range(d))
    sc = ", ".join(f"CASE WHEN hi{i} = lo{i} THEN 0.5 ELSE (f{i} - lo{i}) / (hi{i} - lo{i}) END"
                   f" AS f{i}" for i in range(d))
    return (f"rng AS (SELECT {mm} FROM {src}), "
            f"sc AS (SELECT idx, label, {sc} FROM {src}, rng)")


def d2_sql(d: int, a: str = "a", b: str = "b") -> str:
    return " + ".join(f"({a}.f{i} - {b}.f{i}) * ({a}.f{i} - {b}.f{i})" for i in range(d))


def knn_sql(src: str, d: int, k: int, name: str = "nn") -> str:
    """Exact self-kNN of CTE ``src`` (self excluded, ties by neighbour id)."""
    return (f"{name} AS (SELECT a.idx, a.label, b.idx AS n_idx, b.label AS n_label,"
            f" {d2_sql(d)} AS d2, row_number() OVER (PARTITION BY a.idx ORDER BY {d2_sql(d)},"
            f" b.idx) AS rn FROM {src} a JOIN {src} b ON a.idx <> b.idx QUALIFY rn <= {k})")


def grade_case(same: str, k: int) -> str:
    return (f"CASE WHEN 5 * {same} >= {4 * k} THEN 0 WHEN 5 * {same} >= {2 * k} THEN 1"
            f" WHEN 5 * {same} >= {k} THEN 2 ELSE 3 END")


def graded_sql(src: str, nn: str, k: int, name: str = "g") -> str:
    """``g(idx, label, minority_type, f..)`` from scaled rows and their neighbours."""
    return (f"{name} AS (SELECT s.*, CAST({grade_case('coalesce(c.same, 0)', k)} AS INTEGER)"
            f" AS minority_type FROM {src} s LEFT JOIN (SELECT idx, sum(CASE WHEN n_label = label"
            f" THEN 1 ELSE 0 END) AS same FROM {nn} GROUP BY idx) c ON s.idx = c.idx)")


def doc_graded_prefix(k: int = 5, ds: str = "DS_DOC") -> str:
    body, d = ds_sql(ds)
    return (f"WITH ds AS ({body}), {scaled_sql('ds', d)}, {knn_sql('sc', d, k)}, "
            f"{graded_sql('sc', 'nn', k)}")


def draw_sql(n: str, *parts: str, seed: int = SEED) -> str:
    """md5 draw position, same bits as ``draw_position`` in Spark."""
    key = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(CAST(('0x' || substr(md5({key}), 1, 15)) AS BIGINT) % {n})"


def round_cols(d: int, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}f{i}, {digits}) AS f{i}" for i in range(d))


def fold_sql(src: str, name: str = "fo", splits: int = 5) -> str:
    """``fold`` by rank of idx: contiguous folds of size n // splits, the last takes the rest."""
    return (f"{name} AS (SELECT *, CAST(CASE WHEN (count(*) OVER ()) // {splits} = 0 THEN"
            f" {splits - 1} ELSE least((row_number() OVER (ORDER BY idx) - 1) //"
            f" ((count(*) OVER ()) // {splits}), {splits - 1}) END AS INTEGER) AS fold FROM {src})")


def vote_confusion_sql(src: str, d: int, k: int = 5) -> str:
    """kNN-vote predictions of each fold's rows from the other folds, as a confusion table
    ``conf(fold, label, prediction, n)``; needs CTE ``src`` with fold."""
    return (f"pr AS (SELECT t.fold, t.idx, t.label, r.idx AS n_idx, r.label AS n_label,"
            f" row_number() OVER (PARTITION BY t.fold, t.idx ORDER BY {d2_sql(d, 't', 'r')},"
            f" r.idx) AS rn FROM {src} t JOIN {src} r ON r.fold <> t.fold QUALIFY rn <= {k}),"
            " votes AS (SELECT fold, idx, label, n_label, count(*) AS v FROM pr"
            " GROUP BY fold, idx, label, n_label),"
            " pred AS (SELECT fold, idx, label, n_label AS prediction, row_number() OVER"
            " (PARTITION BY fold, idx ORDER BY v DESC, n_label) AS r FROM votes QUALIFY r = 1),"
            " conf AS (SELECT fold, label, prediction, count(*) AS n FROM pred"
            " GROUP BY fold, label, prediction)")


def rates_sql(conf: str = "conf", keys: str = "fold") -> str:
    """``rates(keys, label, tp, fn, fp, tn, has_test)`` from a long confusion table."""
    on = " AND ".join(f"{{a}}.{c.strip()} = {{b}}.{c.strip()}" for c in keys.split(","))

    def j(a, b):
        return on.format(a=a, b=b)
    return (f"rs AS (SELECT {keys}, label AS c, sum(n) AS row_n FROM {conf} GROUP BY {keys}, label),"
            f" cs AS (SELECT {keys}, prediction AS c, sum(n) AS col_n FROM {conf}"
            f" GROUP BY {keys}, prediction),"
            f" tpt AS (SELECT {keys}, label AS c, sum(n) AS tp FROM {conf} WHERE label = prediction"
            f" GROUP BY {keys}, label),"
            f" tot AS (SELECT {keys}, sum(n) AS total FROM {conf} GROUP BY {keys}),"
            f" cl AS (SELECT {keys}, c FROM rs UNION SELECT {keys}, c FROM cs),"
            f" rates AS (SELECT {', '.join('cl.' + c.strip() for c in keys.split(','))},"
            " CAST(cl.c AS INTEGER) AS label,"
            " CAST(coalesce(tpt.tp, 0) AS BIGINT) AS tp,"
            " CAST(coalesce(rs.row_n, 0) - coalesce(tpt.tp, 0) AS BIGINT) AS fn,"
            " CAST(coalesce(cs.col_n, 0) - coalesce(tpt.tp, 0) AS BIGINT) AS fp,"
            " CAST(tot.total - coalesce(rs.row_n, 0) - coalesce(cs.col_n, 0) + coalesce(tpt.tp, 0)"
            " AS BIGINT) AS tn, coalesce(rs.row_n, 0) > 0 AS has_test"
            f" FROM cl LEFT JOIN rs ON {j('rs', 'cl')} AND rs.c = cl.c"
            f" LEFT JOIN cs ON {j('cs', 'cl')} AND cs.c = cl.c"
            f" LEFT JOIN tpt ON {j('tpt', 'cl')} AND tpt.c = cl.c"
            f" JOIN tot ON {j('tot', 'cl')})")


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def _fb(p: str, r: str, beta: float = 0.5) -> str:
    b2 = beta * beta
    return _div(f"{1 + b2} * {p} * {r}", f"{b2} * {p} + {r}")


def metrics_sql(rates: str = "rates", keys: str = "fold", beta: float = 0.5) -> str:
    """``met(keys, AvAvg .. CBA, n_classes_scored)`` (unrounded)."""
    return (f"per AS (SELECT {keys}, has_test, tp, fn, fp,"
            f" {_div('tp + tn', 'tp + tn + fp + fn')} AS acc, {_div('tp', 'tp + fn')} AS rec,"
            f" {_div('tp', 'tp + fp')} AS prec, {_div('tp', 'greatest(tp + fn, tp + fp)')} AS cba"
            f" FROM {rates}),"
            f" per2 AS (SELECT *, {_fb('prec', 'rec', beta)} AS fb FROM per),"
            f" agg AS (SELECT {keys}, avg(acc) FILTER (WHERE has_test) AS AvAvg,"
            " min(rec) FILTER (WHERE has_test) AS minrec,"
            " avg(ln(rec)) FILTER (WHERE has_test AND rec > 0) AS lnrec,"
            " avg(rec) FILTER (WHERE has_test) AS RecM, avg(prec) FILTER (WHERE has_test) AS PrecM,"
            " sum(tp) AS stp, sum(tp + fn) AS st, sum(tp + fp) AS sp,"
            " avg(fb) FILTER (WHERE has_test) AS AvFb, avg(cba) FILTER (WHERE has_test) AS CBA,"
            f" count(*) FILTER (WHERE has_test) AS n_classes_scored FROM per2 GROUP BY {keys}),"
            f" met AS (SELECT {keys}, AvAvg, CASE WHEN minrec > 0 THEN exp(lnrec) ELSE 0.0 END AS MAvG,"
            f" RecM, PrecM, {_div('stp', 'st')} AS Recu, {_div('stp', 'sp')} AS Precu,"
            f" {_fb('PrecM', 'RecM', beta)} AS FbM,"
            f" {_fb(_div('stp', 'sp'), _div('stp', 'st'), beta)} AS Fbu, AvFb, CBA,"
            f" CAST(n_classes_scored AS BIGINT) AS n_classes_scored FROM agg)")


METRIC_COLS = ("AvAvg", "MAvG", "RecM", "PrecM", "Recu", "Precu", "FbM", "Fbu", "AvFb", "CBA")


def round_metrics(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{m}, 6) AS {m}" for m in METRIC_COLS)
