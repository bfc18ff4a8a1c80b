"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on the pre-registered views (``orders``, ``customer``, ...). Shared CTEs for
the fixture views come from :mod:`riskweave.views`; ordered windows here are the plain
single-window forms, which the Spark side computes with two-level ranks.
"""

from __future__ import annotations

from riskweave.views import FOLDS_SQL, PREDS_SQL, T_SQL, with_sql

BASE = with_sql(T_SQL, FOLDS_SQL, PREDS_SQL)

KFOLD_SQL = """tk AS (
  SELECT t.*, CAST((row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold
  FROM t
)"""


def auc_sql(src: str, groups: list[str], score: str = "p", label: str = "target",
            out: str = "auc", extra_select: str = "") -> str:
    """SELECT ... AUC per group from relation ``src`` (no WITH; used as a subquery)."""
    g = ", ".join(groups)
    gsel = (g + ", ") if groups else ""
    part = f"PARTITION BY {g} " if groups else ""
    grp = f"GROUP BY {g}" if groups else ""
    return f"""SELECT {gsel}sum(pos * (nb + CAST(neg AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS {out}{extra_select}
FROM (
  SELECT {gsel}pos, neg,
         coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM (SELECT {gsel}CAST({score} AS DOUBLE) AS s, sum(CAST({label} AS BIGINT)) AS pos,
               sum(1 - CAST({label} AS BIGINT)) AS neg
        FROM {src} GROUP BY {gsel}CAST({score} AS DOUBLE)) cells
) ranked {grp}"""


def R6(expr: str) -> str:
    """Same rounding as the Spark side: round(x * 1e6) / 1e6 (identical IEEE steps)."""
    return f"(round(CAST({expr} AS DOUBLE) * 1e6) / 1e6)"


ORACLE: dict[str, str] = {}

ORACLE["stratified_kfold"] = BASE + "SELECT id, fold FROM tf"

ORACLE["kfold"] = with_sql(T_SQL, KFOLD_SQL) + "SELECT id, fold FROM tk"

ORACLE["fold_balance"] = BASE + """SELECT fold, target, count(*) AS n FROM tf GROUP BY fold, target"""

ORACLE["target_encode_oof"] = with_sql(T_SQL, KFOLD_SQL) + """,
g AS (SELECT avg(CAST(target AS DOUBLE)) AS gm FROM tk),
kf AS (SELECT city, fold, sum(target) AS s, count(*) AS n FROM tk WHERE city IS NOT NULL GROUP BY city, fold),
kt AS (SELECT city, sum(s) AS s, sum(n) AS n FROM kf GROUP BY city)
SELECT tk.id,
       {R6_}((10 * g.gm + coalesce(CASE WHEN kt.n - kf.n > 0 THEN CAST(kt.s - kf.s AS DOUBLE) / (kt.n - kf.n) END, g.gm)) / 11) AS enc
FROM tk CROSS JOIN g
LEFT JOIN kf ON tk.city = kf.city AND tk.fold = kf.fold
LEFT JOIN kt ON tk.city = kt.city"""

ORACLE["target_encode_apply"] = BASE + """,
tr AS (SELECT * FROM tf WHERE fold <> 0),
g AS (SELECT avg(CAST(target AS DOUBLE)) AS gm FROM tr),
m AS (SELECT city, avg(CAST(target AS DOUBLE)) AS m FROM tr WHERE city IS NOT NULL GROUP BY city)
SELECT tf.id, {R6_}((10 * g.gm + coalesce(m.m, g.gm)) / 11) AS enc
FROM tf CROSS JOIN g LEFT JOIN m ON tf.city = m.city"""

ORACLE["roc_auc"] = BASE + "SELECT model, {R6_}(auc) AS auc FROM (" + auc_sql("preds", ["model"]) + ") a"

ORACLE["auc_by_fold"] = BASE + "SELECT model, fold, {R6_}(auc) AS auc FROM (" + \
    auc_sql("preds", ["model", "fold"]) + ") a"

ORACLE["cv_auc"] = BASE + "SELECT model, {R6_}(avg(auc)) AS cv_auc FROM (" + \
    auc_sql("preds", ["model", "fold"]) + ") a GROUP BY model"

ORACLE["confusion"] = BASE + """,
cells AS (SELECT m.model, a.actual, b.predicted
          FROM (SELECT DISTINCT model FROM preds) m, (VALUES (0), (1)) a(actual), (VALUES (0), (1)) b(predicted)),
c AS (SELECT model, CAST(target AS INTEGER) AS actual, CAST(p > 0.5 AS INTEGER) AS predicted, count(*) AS n
      FROM preds GROUP BY ALL)
SELECT cells.model, cells.actual, cells.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM cells LEFT JOIN c USING (model, actual, predicted)"""

ORACLE["pr_curve"] = BASE + """,
cells AS (SELECT model, p AS s, sum(target) AS pos, sum(1 - target) AS neg FROM preds GROUP BY model, p),
cum AS (SELECT model, s,
               sum(pos) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
               sum(pos) OVER (PARTITION BY model) AS tot
        FROM cells)
SELECT model, {R6_}(s) AS threshold, {R6_}(CAST(tp AS DOUBLE) / (tp + fp)) AS precision,
       {R6_}(CAST(tp AS DOUBLE) / tot) AS recall FROM cum
UNION ALL
SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM preds"""

ORACLE["log_loss"] = BASE + """SELECT model,
  {R6_}(-avg(target * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - target) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS log_loss
FROM preds GROUP BY model"""


# ---------------------------------------------------------------- schema and features

TB = with_sql(T_SQL)
_STRS = ["segment", "priority", "nation", "account", "city"]


def _nd(c: str) -> str:
    return f"(SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM t)"


ORACLE["detect_columns"] = TB + "SELECT * FROM (VALUES ('id', 'id', CAST(NULL AS BIGINT)), ('target', 'target', NULL), " \
    "('amount', 'numeric', NULL), ('balance', 'numeric', NULL), ('date_as', 'date', NULL), ('date_os', 'date', NULL)) " \
    "v(column_name, role, n_distinct_incl_missing)\n" + "\n".join(
        f"UNION ALL SELECT '{c}', CASE WHEN n < 30 THEN 'low_card' ELSE 'high_card' END, CAST(n AS BIGINT) "
        f"FROM (SELECT {_nd(c)} AS n) x" for c in _STRS)

_low_cats = "\nUNION ALL ".join(
    f"SELECT 2 AS sec, {i} AS pos, '{c}=' || v AS name, 'onehot' AS family, '{c}' AS source_col, v AS category "
    f"FROM (SELECT DISTINCT coalesce({c}, '__missing__') AS v FROM t) WHERE {_nd(c)} < 30"
    for i, c in enumerate(_STRS))
_any_high = " OR ".join(f"{_nd(c)} >= 30" for c in _STRS)
ORACLE["feature_lineage"] = TB + f""",
rows AS (
  SELECT 0 AS sec, p.pos AS pos, p.name AS name, 'date' AS family, p.src AS source_col, CAST(NULL AS VARCHAR) AS category
  FROM (VALUES (0, 'date_as_year', 'date_as'), (1, 'date_as_month', 'date_as'), (2, 'date_as_day', 'date_as'),
               (3, 'date_as_age_days', 'date_as'), (4, 'date_os_year', 'date_os'), (5, 'date_os_month', 'date_os'),
               (6, 'date_os_day', 'date_os'), (7, 'date_os_age_days', 'date_os')) p(pos, name, src)
  UNION ALL SELECT 1, 0, 'amount', 'numeric', 'amount', NULL
  UNION ALL SELECT 1, 1, 'balance', 'numeric', 'balance', NULL
  UNION ALL {_low_cats}
  UNION ALL SELECT 3, i, 'hash_' || CAST(i AS VARCHAR), 'hash', NULL, NULL FROM range(64) r(i) WHERE {_any_high}
)
SELECT CAST(row_number() OVER (ORDER BY sec, pos, category) - 1 AS INTEGER) AS idx, name, family, source_col, category
FROM rows"""

ORACLE["date_parse"] = TB + """SELECT id, CAST(try_cast(date_as AS TIMESTAMP) AS VARCHAR) AS date_as,
       CAST(try_cast(date_os AS TIMESTAMP) AS VARCHAR) AS date_os FROM t"""

ORACLE["date_features"] = TB + "SELECT id, " + ", ".join(
    f"CAST(coalesce({fn}(try_cast({c} AS TIMESTAMP)), 0) AS BIGINT) AS {c}_{part}"
    for c in ("date_as", "date_os") for fn, part in (("year", "year"), ("month", "month"), ("day", "day"))) + " FROM t"

ORACLE["date_age"] = """SELECT event_id,
  CAST(coalesce(floor(date_diff('microsecond', ts, (SELECT max(ts) FROM events)) / 86400000000), 999999) AS BIGINT) AS ts_age_days
FROM events"""

ORACLE["days_between"] = TB + """SELECT id,
  CAST(floor(date_diff('microsecond', try_cast(date_os AS TIMESTAMP), try_cast(date_as AS TIMESTAMP)) / 86400000000) AS BIGINT) AS days_between_as_os
FROM t"""

ORACLE["median_impute"] = TB + """SELECT id, {R6_}(coalesce(amount, (SELECT median(amount) FROM t))) AS amount,
       {R6_}(coalesce(balance, (SELECT median(balance) FROM t))) AS balance FROM t"""

ORACLE["standard_scale"] = TB + """,
f AS (SELECT id, coalesce(amount, (SELECT median(amount) FROM t)) AS a, coalesce(balance, (SELECT median(balance) FROM t)) AS b FROM t),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f)
SELECT id, {R6_}((a - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END) AS amount,
       {R6_}((b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END) AS balance FROM f, m"""

_oh_cols = ["segment", "priority", "nation"]
ORACLE["one_hot"] = BASE + ",\ncats AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS category_index "
    f"FROM (SELECT DISTINCT coalesce({c}, '__missing__') AS v FROM tf WHERE fold <> 0)" for c in _oh_cols) + \
    "),\nvals AS (" + "\nUNION ALL ".join(
        f"SELECT id, '{c}' AS column_name, coalesce({c}, '__missing__') AS v FROM tf" for c in _oh_cols) + \
    ")\nSELECT vals.id, vals.column_name, cats.category_index FROM vals JOIN cats USING (column_name, v)"

ORACLE["cat_fill"] = TB + "SELECT id, coalesce(segment, 'NA') AS segment, coalesce(city, 'NA') AS city FROM t"

ORACLE["hash_features"] = TB + """,
toks AS (SELECT id, 'account=' || coalesce(account, '__missing__') AS tok FROM t
         UNION ALL SELECT id, 'city=' || coalesce(city, '__missing__') FROM t),
hb AS (SELECT id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket,
              CASE WHEN ('0x' || substr(md5(tok), 9, 1))::BIGINT % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS sign
       FROM toks)
SELECT id, bucket, sum(sign) AS value FROM hb GROUP BY id, bucket HAVING sum(sign) <> 0"""

ORACLE["label_encode"] = TB + """,
codes AS (SELECT city, CAST(row_number() OVER (ORDER BY city) - 1 AS BIGINT) AS code
          FROM (SELECT DISTINCT city FROM t WHERE city IS NOT NULL))
SELECT t.id, codes.code FROM t LEFT JOIN codes ON t.city = codes.city"""

ORACLE["frequency_encode"] = TB + """,
fr AS (SELECT city, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM t) AS freq FROM t GROUP BY city)
SELECT t.id, {R6_}(fr.freq) AS freq FROM t LEFT JOIN fr ON t.city IS NOT DISTINCT FROM fr.city"""

ORACLE["interactions"] = TB + """SELECT id, {R6_}(amount * balance) AS amount_x_balance,
       concat_ws('_', segment, priority) AS segment_x_priority FROM t"""

ORACLE["group_stats"] = TB + """,
g AS (SELECT segment, avg(amount) AS m, stddev_pop(amount) AS s, count(amount) AS n FROM t GROUP BY segment)
SELECT t.id, {R6_}(g.m) AS amount_mean_by_segment, {R6_}(g.s) AS amount_std_by_segment,
       CAST(g.n AS BIGINT) AS amount_n_by_segment
FROM t LEFT JOIN g ON t.segment IS NOT DISTINCT FROM g.segment"""

ORACLE["group_mean"] = TB + """SELECT segment, {R6_}(avg(target)) AS target_mean, count(*) AS n FROM t GROUP BY segment"""

ORACLE["numeric_projection"] = TB + "SELECT id, target, amount, balance FROM t"

ORACLE["align_schema"] = TB + """SELECT id, target, amount, CAST(NULL AS DOUBLE) AS balance, segment, priority, nation,
       account, city, date_as, date_os FROM t"""



# ---------------------------------------------------------------- profiling

_T_COLS = [("id", "bigint"), ("target", "int"), ("amount", "double"), ("balance", "double"),
           ("segment", "string"), ("priority", "string"), ("nation", "string"), ("account", "string"),
           ("city", "string"), ("date_as", "string"), ("date_os", "string")]

ORACLE["null_counts"] = TB + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing FROM t"
    for c, _ in _T_COLS)

ORACLE["null_fraction"] = TB + "SELECT column_name, {R6_}(fraction) AS fraction FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS fraction FROM t"
    for c, _ in _T_COLS) + ") ORDER BY fraction DESC, column_name LIMIT 20"

ORACLE["nunique"] = TB + "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM t"
    for c, ty in _T_COLS if ty == "string") + ") ORDER BY n_unique DESC, column_name LIMIT 50"

ORACLE["table_info"] = TB + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{ty}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null, "
    f"CAST(count(*) AS BIGINT) AS n_rows FROM t" for c, ty in _T_COLS)

ORACLE["value_counts"] = TB + "SELECT segment AS value, count(*) AS n FROM t WHERE segment IS NOT NULL GROUP BY segment"

ORACLE["value_share"] = TB + """SELECT value, {R6_}(n / sum(n) OVER ()) AS share
FROM (SELECT target AS value, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY target)"""

DOCS = """docs AS (
  SELECT doc_id, CAST(length(text) AS BIGINT) AS text_len,
         CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS word_count
  FROM documents
)"""

ORACLE["text_lengths"] = with_sql(DOCS) + "SELECT doc_id, text_len, word_count FROM docs"

ORACLE["histogram"] = with_sql(DOCS) + """,
mm AS (SELECT CAST(min(text_len) AS DOUBLE) AS mn, CAST(max(text_len) AS DOUBLE) AS mx FROM docs),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((CAST(text_len AS DOUBLE) - mn) / (mx - mn) * 50.0), 49) END AS INTEGER) AS bin
      FROM docs, mm)
SELECT r.bin, {R6_}(mn + r.bin * CASE WHEN mx > mn THEN (mx - mn) / 50 ELSE 1.0 END) AS lo,
       {R6_}(mn + (r.bin + 1) * CASE WHEN mx > mn THEN (mx - mn) / 50 ELSE 1.0 END) AS hi, count(b.bin) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) r CROSS JOIN mm LEFT JOIN b ON b.bin = r.bin
WHERE mn IS NOT NULL GROUP BY r.bin, mn, mx"""

ORACLE["box_stats"] = with_sql(DOCS) + """,
d AS (SELECT docs.*, labels.toxic FROM docs JOIN labels USING (doc_id)),
q AS (SELECT toxic, quantile_cont(word_count, 0.25) AS q1, quantile_cont(word_count, 0.5) AS med,
             quantile_cont(word_count, 0.75) AS q3 FROM d GROUP BY toxic),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.toxic, {R6_}(q1) AS q1, {R6_}(med) AS median, {R6_}(q3) AS q3, {R6_}(iqr) AS iqr,
       {R6_}(min(CASE WHEN word_count BETWEEN lo AND hi THEN word_count END)) AS whisker_lo,
       {R6_}(max(CASE WHEN word_count BETWEEN lo AND hi THEN word_count END)) AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT (word_count BETWEEN lo AND hi)) AS BIGINT) AS n_outliers,
       CAST(count(word_count) AS BIGINT) AS n
FROM d JOIN f USING (toxic) GROUP BY f.toxic, q1, med, q3, iqr"""


# ---------------------------------------------------------------- ensembling and search

from riskweave.operators.ensemble import candidates as _cands  # noqa: E402

_MODELS = ["lgb", "cat", "xgb"]


def _d(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


AUCW = "aucw AS (SELECT model, auc, auc / sum(auc) OVER () AS weight FROM (" + auc_sql("preds", ["model"]) + ") a)"

ORACLE["auc_weights"] = BASE + ",\n" + AUCW + "\nSELECT model, {R6_}(auc) AS auc, {R6_}(weight) AS weight FROM aucw"

ORACLE["blend_weighted"] = BASE + ",\n" + AUCW + """
SELECT id, {R6_}(sum(weight * p)) AS p FROM preds JOIN aucw USING (model) GROUP BY id"""

ORACLE["blend_fixed"] = BASE + ",\n" + AUCW + """,
stack AS (SELECT id, sum(weight * p) AS p FROM preds JOIN aucw USING (model) GROUP BY id)
SELECT s.id, {R6_}(""" + f"{_d(0.5)} * s.p + {_d(0.3)} * pw.cat + {_d(0.15)} * pw.lgb + {_d(0.05)} * pw.xgb" + """) AS p
FROM stack s JOIN pw ON s.id = pw.id"""

ORACLE["stack_matrix"] = BASE + "SELECT id, fold, target, lgb, cat, xgb FROM pw"


_SEARCH = ["stack", "cat", "lgb", "xgb"]
PW4 = AUCW + """,
pw4 AS (SELECT pw.*, wl.weight * lgb + wc.weight * cat + wx.weight * xgb AS stack
  FROM pw, (SELECT weight FROM aucw WHERE model = 'lgb') wl, (SELECT weight FROM aucw WHERE model = 'cat') wc,
       (SELECT weight FROM aucw WHERE model = 'xgb') wx)"""


def _cand_scores(cands, name="cs"):
    rows = "\nUNION ALL ".join(
        f"SELECT id, fold, target, {i} AS candidate, "
        + " + ".join(f"{_d(w[m])} * {m}" for m in _SEARCH) + " AS score FROM pw4"
        for i, w in enumerate(cands))
    return f"{name} AS ({rows})"


_C = _cands(_SEARCH, 100, 42)
_CW = "cw AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, " + ", ".join(_d(w[m]) for m in _SEARCH) + ")" for i, w in enumerate(_C)) + \
    ") v(candidate, " + ", ".join(f"w_{m}" for m in _SEARCH) + "))"
_SEARCHED = BASE + ",\n" + PW4 + ",\n" + _cand_scores(_C) + ",\n" + _CW + """,
a AS (""" + auc_sql("cs", ["candidate"], score="score") + ")"
ORACLE["blend_search"] = _SEARCHED + """
SELECT a.candidate, {R6_}(w_stack) AS w_stack, {R6_}(w_cat) AS w_cat, {R6_}(w_lgb) AS w_lgb, {R6_}(w_xgb) AS w_xgb, {R6_}(auc) AS auc,
       row_number() OVER (ORDER BY auc DESC, a.candidate) = 1 AS best
FROM a JOIN cw USING (candidate)"""

ORACLE["blend_bounds"] = _SEARCHED + """,
st AS (SELECT candidate, CAST(floor(least(greatest(score, 0.0::DOUBLE), 1.0::DOUBLE) * 1024.0::DOUBLE) AS INTEGER) AS step,
              sum(target) AS pos, sum(1 - target) AS neg FROM cs GROUP BY ALL),
sb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY candidate ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM st),
bd AS (SELECT candidate, sum(pos * below) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS lower,
              sum(pos * (below + neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS upper FROM sb GROUP BY candidate)
SELECT bd.candidate, {R6_}(lower) AS lower, {R6_}(upper) AS upper,
       CASE WHEN upper >= (SELECT max(lower) FROM bd) - 1e-12 THEN {R6_}(auc) END AS auc,
       row_number() OVER (ORDER BY auc DESC, bd.candidate) = 1 AS best
FROM bd JOIN a ON a.candidate = bd.candidate"""

ORACLE["blend_apply"] = _SEARCHED + """,
best AS (SELECT cw.* FROM a JOIN cw USING (candidate) ORDER BY auc DESC, a.candidate LIMIT 1)
SELECT id, {R6_}(w_stack * stack + w_cat * cat + w_lgb * lgb + w_xgb * xgb) AS p FROM pw4, best"""

_TR = _cands(_SEARCH, 100, 7)
TRIALS = PW4 + ",\n" + _cand_scores(_TR) + ",\ntrials AS (SELECT candidate AS trial, fold, auc FROM (" + \
    auc_sql("cs", ["candidate", "fold"], score="score") + ") a)"

ORACLE["median_prune"] = BASE + ",\n" + TRIALS + """,
rep AS (SELECT trial, fold, round(avg(auc) OVER (PARTITION BY trial ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 1e9) / 1e9 AS report FROM trials),
fl AS (SELECT trial, fold,
              max(report) OVER (PARTITION BY trial ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best,
              median(report) OVER (PARTITION BY fold ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med,
              count(*) OVER (PARTITION BY fold ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before
       FROM rep)
SELECT tr.trial, CAST(min(fl.fold) AS INTEGER) AS pruned_at
FROM (SELECT DISTINCT trial FROM trials) tr
LEFT JOIN fl ON tr.trial = fl.trial AND fl.n_before >= 10 AND fl.best < fl.med
GROUP BY tr.trial"""

_TW = "tw AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, " + ", ".join(_d(w[m]) for m in _SEARCH) + ")" for i, w in enumerate(_TR)) + \
    ") v(trial, " + ", ".join(f"w_{m}" for m in _SEARCH) + "))"
ORACLE["best_trial"] = BASE + ",\n" + TRIALS + ",\n" + _TW + """,
b AS (SELECT trial, avg(auc) AS auc FROM trials GROUP BY trial ORDER BY avg(auc) DESC, trial LIMIT 1)
SELECT trial, {R6_}(auc) AS auc, {R6_}(w_stack) AS w_stack, {R6_}(w_cat) AS w_cat, {R6_}(w_lgb) AS w_lgb, {R6_}(w_xgb) AS w_xgb
FROM b JOIN tw USING (trial)"""

ORACLE["fold_average"] = BASE + """,
tot AS (SELECT sum(target) AS s, count(*) AS n FROM tf),
fg AS (SELECT fold, CAST(tot.s - sum(target) AS DOUBLE) / (tot.n - count(*)) AS gm FROM tf, tot GROUP BY fold, tot.s, tot.n),
cells AS (SELECT city, fold, sum(target) AS s, count(*) AS n FROM tf WHERE city IS NOT NULL GROUP BY city, fold),
grid AS (SELECT k.city, f.fold FROM (SELECT DISTINCT city FROM cells) k, (SELECT DISTINCT fold FROM fg) f),
st AS (SELECT g.city, g.fold,
              sum(coalesce(c.s, 0)) OVER (PARTITION BY g.city) - coalesce(c.s, 0) AS os,
              sum(coalesce(c.n, 0)) OVER (PARTITION BY g.city) - coalesce(c.n, 0) AS on_
       FROM grid g LEFT JOIN cells c ON g.city = c.city AND g.fold = c.fold),
enc AS (SELECT st.city, avg((10 * fg.gm + coalesce(CASE WHEN on_ > 0 THEN CAST(os AS DOUBLE) / on_ END, fg.gm)) / 11) AS p
        FROM st JOIN fg USING (fold) GROUP BY st.city),
gavg AS (SELECT avg((10 * gm + gm) / 11) AS g FROM fg)
SELECT tf.id, {R6_}(coalesce(enc.p, gavg.g)) AS p FROM tf CROSS JOIN gavg LEFT JOIN enc ON tf.city = enc.city"""

ORACLE["sample_n"] = TB + "SELECT id FROM t ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 500"


# ---------------------------------------------------------------- explanation

_ATTR = ["amount", "balance", "date_as_year", "date_as_month", "date_as_day", "date_as_age_days",
         "date_os_year", "date_os_month", "date_os_day", "date_os_age_days"]
_COEFS = {"lgb": [0.8, -0.5, 0.3, 0.2, -0.1, 0.05, 0.25, -0.15, 0.12, 0.04],
          "cat": [0.4, 0.6, -0.2, 0.1, 0.3, -0.05, -0.35, 0.45, 0.08, -0.03],
          "xgb": [-0.3, 0.2, 0.5, -0.4, 0.1, 0.02, 0.15, 0.22, -0.18, 0.01]}
_META = {"lgb": 0.6, "cat": 0.3, "xgb": 0.1}

XMAT = """f AS (SELECT id, coalesce(amount, (SELECT median(amount) FROM t)) AS a,
              coalesce(balance, (SELECT median(balance) FROM t)) AS b, date_as, date_os FROM t),
mo AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f),
mx AS (SELECT max(try_cast(date_os AS TIMESTAMP)) AS mos, max(try_cast(date_as AS TIMESTAMP)) AS mas FROM t),
x AS (SELECT id,
  (a - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END AS amount,
  (b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END AS balance,
  CAST(coalesce(year(try_cast(date_as AS TIMESTAMP)), 0) AS DOUBLE) AS date_as_year,
  CAST(coalesce(month(try_cast(date_as AS TIMESTAMP)), 0) AS DOUBLE) AS date_as_month,
  CAST(coalesce(day(try_cast(date_as AS TIMESTAMP)), 0) AS DOUBLE) AS date_as_day,
  CAST(coalesce(floor(date_diff('microsecond', try_cast(date_as AS TIMESTAMP), mas) / 86400000000), 999999) AS DOUBLE) AS date_as_age_days,
  CAST(coalesce(year(try_cast(date_os AS TIMESTAMP)), 0) AS DOUBLE) AS date_os_year,
  CAST(coalesce(month(try_cast(date_os AS TIMESTAMP)), 0) AS DOUBLE) AS date_os_month,
  CAST(coalesce(day(try_cast(date_os AS TIMESTAMP)), 0) AS DOUBLE) AS date_os_day,
  CAST(coalesce(floor(date_diff('microsecond', try_cast(date_os AS TIMESTAMP), mos) / 86400000000), 999999) AS DOUBLE) AS date_os_age_days
  FROM f, mo, mx),
xm AS (SELECT """ + ", ".join(f"avg({c}) AS m{j}" for j, c in enumerate(_ATTR)) + """ FROM x),
attr AS (""" + "\nUNION ALL ".join(
    f"SELECT id, '{m}' AS model, {j} AS feature_idx, {c} AS value, {_d(cs[j])} * ({c} - m{j}) AS phi FROM x, xm"
    for m, cs in _COEFS.items() for j, c in enumerate(_ATTR)) + """),
lin AS (SELECT * FROM (VALUES """ + ", ".join(f"({j}, '{c}')" for j, c in enumerate(_ATTR)) + """) v(idx, name))"""

XB = with_sql(T_SQL, XMAT)

ORACLE["linear_shap"] = XB + "SELECT id, model, feature_idx, {R6_}(phi) AS phi FROM attr"

ORACLE["mean_abs_attribution"] = XB + """SELECT feature_idx, lin.name AS feature_name, {R6_}(avg(abs(phi))) AS mean_abs
FROM attr LEFT JOIN lin ON attr.feature_idx = lin.idx WHERE model = 'lgb' GROUP BY feature_idx, lin.name"""

_RANKED = """ranked AS (SELECT CAST(row_number() OVER (ORDER BY ma DESC, feature_idx) AS INTEGER) AS rank,
                    'f' || CAST(feature_idx AS VARCHAR) AS feature, lin.name AS feature_name, ma AS mean_abs
             FROM (SELECT feature_idx, avg(abs(phi)) AS ma FROM attr WHERE model = 'lgb' GROUP BY feature_idx) m
             LEFT JOIN lin ON m.feature_idx = lin.idx)"""

ORACLE["importance_mapped"] = XB + ",\n" + _RANKED + "\nSELECT rank, feature, feature_name, {R6_}(mean_abs) AS mean_abs FROM ranked"

ORACLE["top_features"] = XB + ",\n" + _RANKED + "\nSELECT rank, feature_name, {R6_}(mean_abs) AS mean_abs FROM ranked WHERE rank <= 20"

ORACLE["stacked_attribution"] = XB + """,
mc AS (SELECT * FROM (VALUES """ + ", ".join(f"('{m}', {_d(c)})" for m, c in _META.items()) + """) v(model, coef))
SELECT id, feature_idx, {R6_}(sum(coef * phi)) AS phi FROM attr JOIN mc USING (model) GROUP BY id, feature_idx"""

_BASE = " + ".join(f"{_d(c)} * m{j}" for j, c in enumerate(_COEFS["lgb"]))
ORACLE["local_waterfall"] = XB + """
SELECT id, CAST(row_number() OVER w AS INTEGER) AS step, feature_idx, {R6_}(phi) AS phi,
       {R6_}((""" + _BASE + """) + sum(phi) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS running
FROM attr, xm WHERE model = 'lgb'
WINDOW w AS (PARTITION BY id ORDER BY abs(phi) DESC, feature_idx)"""

ORACLE["attribution_summary"] = XB + "SELECT id, feature_idx, {R6_}(value) AS value, {R6_}(phi) AS phi FROM attr WHERE model = 'lgb'"

ORACLE["importance_mean"] = with_sql(T_SQL, FOLDS_SQL, XMAT) + """
SELECT lin.name AS feature_name, {R6_}(avg(imp)) AS importance
FROM (SELECT tf.fold, feature_idx, avg(abs(phi)) AS imp FROM attr JOIN tf USING (id) WHERE model = 'lgb'
      GROUP BY tf.fold, feature_idx) pf
LEFT JOIN lin ON pf.feature_idx = lin.idx GROUP BY feature_idx, lin.name"""


# ---------------------------------------------------------------- scoring and checks

_BAND = "CASE WHEN p >= 0.75 THEN 'High' WHEN p >= 0.4 THEN 'Medium' ELSE 'Low' END"
ORACLE["risk_band"] = BASE + f"SELECT id, model, {_BAND} AS band FROM preds"

ORACLE["recommendation"] = BASE + f"""SELECT id, model, CASE {_BAND}
  WHEN 'High' THEN 'Immediate action recommended. Run full scan.'
  WHEN 'Medium' THEN 'Monitor system closely. Update definitions.'
  ELSE 'System appears healthy.' END AS recommendation FROM preds"""

ORACLE["submission_check"] = BASE + """,
ids AS (SELECT DISTINCT id FROM t),
have AS (SELECT DISTINCT model, id FROM preds),
present AS (SELECT h.model, count(*) AS n FROM have h JOIN ids USING (id) GROUP BY h.model),
extra AS (SELECT h.model, count(*) AS n FROM have h ANTI JOIN ids USING (id) GROUP BY h.model),
c AS (SELECT m.model, CAST((SELECT count(*) FROM ids) - coalesce(present.n, 0) AS BIGINT) AS n_missing,
             CAST(coalesce(extra.n, 0) AS BIGINT) AS n_extra
      FROM (SELECT DISTINCT model FROM preds) m LEFT JOIN present USING (model) LEFT JOIN extra USING (model))
SELECT model, n_missing, n_extra, n_missing = 0 AND n_extra = 0 AS ok FROM c"""

ORACLE["learning_curve_best"] = BASE + """,
cells AS (SELECT target, p AS pb, count(*) AS n FROM preds WHERE model = 'lgb' GROUP BY ALL),
it AS (SELECT cells.*, i AS iter FROM cells, range(200) r(i)),
q AS (SELECT iter, target, n, least(greatest(0.5 + (pb - 0.5) * iter / 100.0, 1e-15), 1 - 1e-15) AS q FROM it),
curve AS (SELECT iter, sum(-(target * ln(q) + (1 - target) * ln(1 - q)) * n) / sum(n) AS loss FROM q GROUP BY iter)
SELECT CAST(arg_min(iter, (loss, iter)) AS BIGINT) AS best_iter, {R6_}(min(loss)) AS best_loss,
       CAST(max(iter) AS BIGINT) AS last_iter, CAST(max(iter) - arg_min(iter, (loss, iter)) AS BIGINT) AS rounds_since_best
FROM curve"""

ORACLE["waiting_point"] = BASE + """,
cells AS (SELECT model, target, p AS pb, count(*) AS n FROM preds GROUP BY ALL),
it AS (SELECT cells.*, i AS iter FROM cells, range(200) r(i)),
q AS (SELECT model, iter, target, n, least(greatest(0.5 + (pb - 0.5) * iter / 100.0, 1e-15), 1 - 1e-15) AS q FROM it),
curve AS (SELECT model, iter, {R6_}(sum(-(target * ln(q) + (1 - target) * ln(1 - q)) * n) / sum(n)) AS loss FROM q GROUP BY ALL),
prior AS (SELECT *, min(loss) OVER (PARTITION BY model ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least_before FROM curve),
steps AS (SELECT *, max(CASE WHEN least_before IS NULL OR loss < least_before THEN iter END) OVER (PARTITION BY model ORDER BY iter) AS best FROM prior),
stops AS (SELECT model, min(iter) AS stop FROM steps WHERE iter - best >= 3 GROUP BY model)
SELECT model, CAST(max(best) AS BIGINT) AS best_iter, {R6_}(min(loss)) AS best_loss, CAST(max(iter) AS BIGINT) AS last_iter,
       CAST(max(iter) - max(best) AS BIGINT) AS rounds_since_best, max(stop) IS NOT NULL AS stopped
FROM steps LEFT JOIN stops USING (model) WHERE stop IS NULL OR iter <= stop GROUP BY model"""


# ---------------------------------------------------------------- sources, payloads, responses

ORACLE["csv_roundtrip"] = TB + """SELECT count(*) AS n, count(amount) AS n_amount, {R6_}(sum(amount)) AS sum_amount,
       {R6_}(sum(balance)) AS sum_balance, count(segment) AS n_segment, count(city) AS n_city,
       count(date_os) AS n_date_os, CAST(sum(target) AS BIGINT) AS sum_target FROM t"""

ORACLE["run_summary"] = BASE + """SELECT (SELECT count(*) FROM t) AS n_rows, 2 AS n_num,
  (""" + " + ".join(f"CAST({_nd(c)} < 30 AS INTEGER)" for c in _STRS) + """) AS n_low,
  (""" + " + ".join(f"CAST({_nd(c)} >= 30 AS INTEGER)" for c in _STRS) + """) AS n_high,
  2 AS n_date, {R6_}(auc) AS auc
FROM (""" + auc_sql("(SELECT * FROM preds WHERE model = 'lgb')", []) + ") a"

ORACLE["payload_parse"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"

PAYLOADS = """req AS (
  SELECT event_id, CASE
    WHEN event_id % 17 IN (0, 6) THEN '{"instance": ' || props || '}'
    WHEN event_id % 17 IN (1, 7) THEN '{"instances": [' || props || ', ' || props || ']}'
    WHEN event_id % 17 IN (2, 8) THEN props
    WHEN event_id % 17 IN (3, 9) THEN '{"instance": {"k": ' || json_extract_string(props, '$.k') || ', "extra_field": 1}}'
    WHEN event_id % 17 IN (4, 10) THEN '{"instance": {"other": 1}}'
    WHEN event_id % 17 = 5 THEN '{"instance": ' || props
    WHEN event_id % 17 = 12 THEN replace('{"instance": ' || props || '}', '"', chr(39))
    WHEN event_id % 17 = 13 THEN props || ' garbage'
    WHEN event_id % 17 = 14 THEN '{"instances": []}'
    WHEN event_id % 17 = 15 THEN '{"instance": {"k": "abc"}}'
    WHEN event_id % 17 = 16 THEN '{"instances": [1, 2]}'
    ELSE '[' || props || ']' END AS payload
  FROM events
),
cls AS (
  SELECT event_id, payload,
         CASE WHEN NOT json_valid(payload) THEN 'invalid JSON'
              WHEN json_type(payload) <> 'OBJECT' OR json_array_length(payload, '$.instances') = 0 THEN 'provide instance or instances'
              WHEN json_type(payload, '$.instance.k') = 'VARCHAR' OR json_type(payload, '$.instances[0]') = 'UBIGINT' THEN 'invalid instance' END AS error
  FROM req
)"""

ORACLE["payload_errors"] = with_sql(PAYLOADS) + """SELECT event_id,
  CAST(CASE WHEN error IS NULL THEN CASE
        WHEN json_exists(payload, '$.instance') THEN 1
        WHEN json_exists(payload, '$.instances') THEN json_array_length(payload, '$.instances')
        ELSE 1 END END AS INTEGER) AS n_instances,
  CAST(CASE WHEN error IS NULL THEN CASE
        WHEN json_exists(payload, '$.instance') THEN coalesce(CAST(json_extract(payload, '$.instance.k') AS BIGINT), 0)
        WHEN json_exists(payload, '$.instances') THEN list_sum(list_transform(CAST(json_extract(payload, '$.instances[*].k') AS BIGINT[]), lambda x: coalesce(x, 0)))
        ELSE coalesce(CAST(json_extract(payload, '$.k') AS BIGINT), 0) END END AS BIGINT) AS k_sum,
  error
FROM cls"""

ORACLE["score_response"] = BASE + """SELECT CAST(floor(id / 10) AS BIGINT) AS request_id,
  '{"n":' || CAST(count(*) AS VARCHAR) || ',"predictions":[' ||
  string_agg('{"probability":' || printf('%.6f', {R6_}(p)) || ',"risk":"' || """ + _BAND + """ || '"}', ',' ORDER BY id) || ']}' AS response
FROM preds WHERE model = 'lgb' GROUP BY floor(id / 10)"""



ORACLE["oof_metrics"] = BASE + """,
pf AS (""" + auc_sql("preds", ["model", "fold"]) + """),
po AS (""" + auc_sql("preds", ["model"]) + """)
SELECT model AS run, 'auc' AS metric, CAST(fold AS INTEGER) AS fold, {R6_}(auc) AS value FROM pf
UNION ALL SELECT model, 'oof_auc', -1, {R6_}(auc) FROM po
UNION ALL SELECT model, 'cv_auc', -1, {R6_}(avg(auc)) FROM pf GROUP BY model
UNION ALL SELECT model, 'log_loss', -1,
  {R6_}(-avg(target * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - target) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))))
FROM preds GROUP BY model"""



ORACLE["roc_auc_grid"] = BASE + ",\npg AS (SELECT model, target, floor(p / 1e-6) * 1e-6 AS pg FROM preds)\n" + \
    "SELECT model, {R6_}(auc) AS auc FROM (" + auc_sql("pg", ["model"], score="pg") + ") a"


# ---------------------------------------------------------------- checks of fitted members

ORACLE["tree_shap_check"] = TB + "SELECT id, true AS all_features, true AS additive FROM t"
ORACLE["gain_importance_check"] = BASE + "SELECT DISTINCT fold, true AS same, true AS whole FROM tf"
ORACLE["oof_check"] = BASE + "SELECT id, fold, target, true AS p_ok FROM tf"
ORACLE["stack_check"] = BASE + """SELECT fold, CAST((SELECT count(*) FROM tf) - count(*) AS BIGINT) AS n_train, true AS optimal FROM tf GROUP BY fold
UNION ALL SELECT -1, count(*), true FROM tf"""
ORACLE["stack_submission"] = TB + "SELECT id, true AS target_ok FROM t"
ORACLE["registry_check"] = BASE + """SELECT model, kind, count(*) AS n_rows, true AS usable
FROM preds, (VALUES ('oof'), ('submission')) v(kind) GROUP BY model, kind"""
ORACLE["artifact_discovery"] = BASE + """SELECT 'cat' AS model, 'oof' AS folder, CAST(NULL AS VARCHAR) AS reason, count(*) AS n_rows, 'p' AS pred_col FROM preds WHERE model = 'cat'
UNION ALL SELECT 'lgb', 'oof', 'row count', count(*), 'prob' FROM preds WHERE model = 'lgb' AND fold <> 0
UNION ALL SELECT 'xgb', 'oof', 'no prediction column', count(*), NULL FROM preds WHERE model = 'xgb'
UNION ALL SELECT 'broken', 'oof', 'unreadable or empty', 0, NULL"""
ORACLE["stream_check"] = with_sql(PAYLOADS) + """SELECT event_id AS request_id,
  CASE WHEN json_exists(payload, '$.instances') THEN CAST(json_array_length(payload, '$.instances') AS BIGINT) ELSE 1 END AS n, true AS p_ok
FROM cls WHERE error IS NULL"""
ORACLE["model_roundtrip"] = TB + "SELECT id, true AS same FROM t"
ORACLE["feature_state_roundtrip"] = ORACLE["feature_lineage"]
ORACLE["attribution_roundtrip"] = XB + "SELECT id, feature_idx, {R6_}(phi) AS phi FROM attr WHERE model = 'cat'"
ORACLE["json_roundtrip"] = ORACLE["run_summary"]

ORACLE["drop_columns"] = TB + "SELECT id, target, amount, balance, segment, priority, nation FROM t"
ORACLE["target_projection"] = TB + "SELECT id, target FROM t"
ORACLE["string_projection"] = TB + "SELECT segment, priority, nation, city, date_as, date_os FROM t"
ORACLE["prediction_column"] = BASE + "SELECT id, {R6_}(p) AS value FROM preds WHERE model = 'xgb'"
ORACLE["row_positions"] = "SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM labels"
ORACLE["attribution_width"] = TB + "SELECT id, CAST(10 AS BIGINT) AS width FROM t"
ORACLE["coerce_flags"] = TB + """SELECT id, CAST(target = 1 AS INTEGER) AS flag,
  CASE WHEN id % 5 <> 0 THEN CAST(id AS DOUBLE) END AS reading FROM t"""
ORACLE["sample_fraction"] = TB + f"""SELECT id FROM t
WHERE ('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8))::BIGINT < {int(0.1 * 0xFFFFFFFF)}"""
ORACLE["head_rows"] = TB + "SELECT id, target, {R6_}(amount) AS amount FROM t ORDER BY id LIMIT 10"
ORACLE["stack_matrix_filled"] = BASE + "SELECT id, fold, target, lgb, CASE WHEN id % 7 = 0 THEN 0.0 ELSE cat END AS cat, xgb FROM pw"
ORACLE["submission_file"] = BASE + ",\n" + AUCW + """
SELECT id, {R6_}(sum(weight * p)) AS target FROM preds JOIN aucw USING (model) GROUP BY id"""
ORACLE["label_encode_account"] = TB + """,
codes AS (SELECT account, CAST(row_number() OVER (ORDER BY account) - 1 AS BIGINT) AS code
          FROM (SELECT DISTINCT account FROM t WHERE account IS NOT NULL))
SELECT t.id, codes.code FROM t LEFT JOIN codes ON t.account = codes.account"""

_high = {c: f"{_nd(c)} >= 30" for c in _STRS}
ORACLE["feature_vector"] = TB + ",\ntok AS (" + "\nUNION ALL ".join(
    f"SELECT id, '{c}=' || coalesce({c}, '__missing__') AS tok FROM t WHERE {_high[c]}" for c in _STRS) + """),
h AS (SELECT id, sum(CASE WHEN ('0x' || substr(md5(tok), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS hash_sum FROM tok GROUP BY id),
w AS (SELECT 10 + """ + " + ".join(f"CASE WHEN {_high[c]} THEN 0 ELSE {_nd(c)} END" for c in _STRS) + """
  + CASE WHEN """ + " OR ".join(_high.values()) + """ THEN 64 ELSE 0 END AS width,
  """ + " + ".join(f"CASE WHEN {_high[c]} THEN 0 ELSE 1 END" for c in _STRS) + """ AS n_low)
SELECT t.id, CAST(w.width AS INTEGER) AS width, CAST(w.n_low AS DOUBLE) AS onehot_sum, coalesce(h.hash_sum, 0.0::DOUBLE) AS hash_sum
FROM t CROSS JOIN w LEFT JOIN h ON t.id = h.id"""


# 20 more text columns (catalog.wide_telemetry); segment, priority and nation stay below 30 values at every size
_WIDE = ["account", "city", *[f"h{i}" for i in range(20)]]
_ENTRIES = TB + ",\nw AS (SELECT t.*, " + ", ".join(
    f"CASE WHEN id % {23 + i} <> 0 THEN 'v' || CAST((id * {2 * i + 3}) % {397 + i} AS VARCHAR) END AS h{i}" for i in range(20)) + """ FROM t),
cat AS (SELECT c, v, CAST(row_number() OVER (ORDER BY c, v) + 9 AS INTEGER) AS idx FROM (
  """ + " UNION ".join(f"SELECT {i} AS c, coalesce({x}, '__missing__') AS v FROM t" for i, x in enumerate(("segment", "priority", "nation"))) + """)),
f AS (SELECT id, coalesce(amount, (SELECT median(amount) FROM t)) AS a, coalesce(balance, (SELECT median(balance) FROM t)) AS b FROM t),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f),
tok AS (""" + " UNION ALL ".join(f"SELECT id, '{x}=' || coalesce({x}, '__missing__') AS tok FROM w" for x in _WIDE) + """),
e AS (
  """ + "\n  UNION ALL ".join(
    f"SELECT id, {4 * i + j} AS idx, CAST(coalesce({fn}(try_cast({x} AS TIMESTAMP)), 0) AS DOUBLE) AS value FROM t"
    for i, x in enumerate(("date_as", "date_os")) for j, fn in enumerate(("year", "month", "day"))) + "\n  UNION ALL " + "\n  UNION ALL ".join(
    f"SELECT id, {4 * i + 3}, CAST(coalesce(floor(date_diff('microsecond', try_cast({x} AS TIMESTAMP), (SELECT max(try_cast({x} AS TIMESTAMP)) FROM t)) / 86400000000), 999999) AS DOUBLE) FROM t"
    for i, x in enumerate(("date_as", "date_os"))) + """
  UNION ALL SELECT id, 8, (a - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END FROM f, m
  UNION ALL SELECT id, 9, (b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END FROM f, m
  """ + " ".join(f"UNION ALL SELECT id, idx, 1.0 FROM t JOIN cat ON cat.c = {i} AND cat.v = coalesce({x}, '__missing__')"
                 for i, x in enumerate(("segment", "priority", "nation"))) + """
  UNION ALL SELECT id, CAST(10 + (SELECT count(*) FROM cat) + ('0x' || substr(md5(tok), 1, 8))::BIGINT % 256 AS INTEGER),
                   sum(CASE WHEN ('0x' || substr(md5(tok), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) FROM tok GROUP BY ALL)
"""
ORACLE["feature_entries"] = _ENTRIES + "SELECT id, idx, {R6_}(value) AS value FROM e WHERE value <> 0"
ORACLE["feature_vector_wide"] = _ENTRIES + """SELECT id, CAST(266 + (SELECT count(*) FROM cat) AS INTEGER) AS width,
       CAST(count(*) FILTER (WHERE value <> 0) AS INTEGER) AS n_entries,
       coalesce(sum(value) FILTER (WHERE idx >= 10 + (SELECT count(*) FROM cat)), 0.0::DOUBLE) AS hash_sum
FROM e GROUP BY id"""


ORACLE["member_match"] = TB + """,
fam AS (SELECT DISTINCT city || '_oof' AS model, lower(city) AS family FROM t WHERE city IS NOT NULL),
fo AS (SELECT DISTINCT 'Run-' || city || '_' || nation AS folder FROM t WHERE city IS NOT NULL AND CAST(substr(city, 2) AS INTEGER) % 3 <> 0),
hit AS (SELECT model, folder, list_contains(regexp_split_to_array(lower(folder), '[^a-z0-9]+'), family) AS exact FROM fam JOIN fo ON contains(lower(folder), family)),
best AS (SELECT *, count(*) OVER (PARTITION BY model) AS n_matches FROM hit
         QUALIFY row_number() OVER (PARTITION BY model ORDER BY exact DESC, length(folder), folder) = 1)
SELECT fam.model, folder, exact, coalesce(n_matches, 0) AS n_matches FROM fam LEFT JOIN best ON fam.model = best.model"""


def _expand_r6(sql: str) -> str:
    """Rewrite every ``{R6_}(expr)`` marker into :func:`R6` (written markers keep SQL short)."""
    out, i, mark = [], 0, "{R6_}("
    while True:
        j = sql.find(mark, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        out.append(R6(_expand_r6(sql[j + len(mark):k - 1])))
        i = k


def finalized() -> dict[str, str]:
    return {k: _expand_r6(v) for k, v in ORACLE.items()}

