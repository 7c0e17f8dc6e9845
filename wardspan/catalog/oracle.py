"""SQL for DuckDB that computes what the registered queries return, from the same tables.

The statements share a chain of views: `enc` (encounters), `cohort`, `stats`, `prepared`, `scored`.
Rank statistics are written as pair counts here, independently of the histograms the engine uses.
"""

from __future__ import annotations

from statistics import NormalDist

from wardspan.catalog import fixed
from wardspan.specs import (
    DEVICE_FLOW_LEVELS,
    DEVICE_MASK_LEVELS,
    DEVICE_O2_LEVELS,
    DEVICE_TEXT_LEVELS,
    ETHNICITY_CODES,
    ORDER_FEATURES,
    RunSettings,
    level_map,
)

F8 = ORDER_FEATURES
SHAP_EXPLAINED = RunSettings().shap_explained
FIT = "('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')"
Z = repr(NormalDist().inv_cdf(0.975))
RATES = ["sensitivity", "specificity", "accuracy", "precision", "npv"]


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name}"


def rounds(names: list[str], digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case_map(column: str, mapping: dict, other: str) -> str:
    arms = " ".join(f"WHEN {text(k)} THEN {text(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {other} END"


def pick(values: list[str], key: str = "encounter_id") -> str:
    return f"list_extract([{', '.join(text(v) for v in values)}], ({key} % {len(values)} + 1)::INTEGER)"


LINE = """line AS (
  SELECT l_orderkey, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, max(l_extendedprice) AS max_price,
         avg(l_discount) AS avg_discount, avg(l_tax) AS avg_tax, count(*)::DOUBLE AS n_lines
  FROM lineitem GROUP BY l_orderkey)"""
ENC = f"""{LINE},
base AS (
  SELECT o.o_orderkey AS encounter_id, r_name AS site, o_orderdate AS arrival_ts,
         (18 + o_custkey % 73)::DOUBLE AS age,
         CASE WHEN substring(md5('g' || o_custkey::VARCHAR), 1, 1) < '8' THEN 'F' ELSE 'M' END AS gender,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'White' WHEN 'BUILDING' THEN 'South Asian' WHEN 'FURNITURE' THEN 'Black'
              WHEN 'HOUSEHOLD' THEN 'Chinese' WHEN 'MACHINERY' THEN 'Mixed' END AS ethnicity,
         sum_qty,
         CASE WHEN o.o_orderkey % 11 <> 0 THEN avg_price END AS avg_price,
         CASE WHEN o.o_orderkey % 11 <> 0 THEN max_price END AS max_price,
         CASE WHEN o.o_orderkey % 11 <> 0 THEN avg_discount END AS avg_discount,
         avg_tax, n_lines, o_totalprice AS total_price, c_acctbal AS account_balance,
         coalesce(sum_qty, 0::DOUBLE) / 100::DOUBLE + o_totalprice / 250000::DOUBLE
           + ((o.o_orderkey * 7919 + 104729) % 1000)::DOUBLE / 1000::DOUBLE AS risk,
         o_orderdate < TIMESTAMP '1998-01-01' AS early
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey LEFT JOIN line ON l_orderkey = o.o_orderkey),
enc AS (
  SELECT * EXCLUDE (risk, early),
         CASE WHEN NOT early THEN (risk > 3.4::DOUBLE)::INTEGER END AS label,
         (encounter_id % 4 = 0)::INTEGER AS discharged, (encounter_id % 4 = 1)::INTEGER AS admission,
         (encounter_id % 4 = 2)::INTEGER AS icu, (encounter_id % 4 = 3)::INTEGER AS death
  FROM base WHERE NOT (early AND risk > 3.4::DOUBLE))"""
COHORT = f"""{ENC},
training AS (
  SELECT * FROM enc WHERE site IN {FIT} AND arrival_ts <= TIMESTAMP '2000-06-30' AND (admission = 1 OR icu = 1)),
cohort AS (
  SELECT encounter_id, site, coalesce(label, 0) AS label, {", ".join(F8)}
  FROM training WHERE label = 1 OR arrival_ts < TIMESTAMP '1998-01-01')"""


def wide(function: str, tag: str) -> str:
    return ", ".join(f"{function}({f}) AS {tag}_{f}" for f in F8)


STATS = f"""{COHORT},
stats AS (
  SELECT site, {wide("median", "med")}, {wide("avg", "mean")}, {wide("min", "lo")}, {wide("max", "hi")}, {wide("count", "n")}
  FROM cohort GROUP BY site),
pooled AS (SELECT {", ".join(f"avg(med_{f}) AS pool_{f}" for f in F8)} FROM stats),
donor AS (SELECT * FROM stats WHERE site = 'AFRICA')"""
OUTSIDE = f"""outside AS (
  SELECT encounter_id, site, 'external' AS split, label, {", ".join(F8)} FROM enc
  WHERE site = 'MIDDLE EAST' AND arrival_ts >= TIMESTAMP '2000-07-01' AND label IN (0, 1) AND (admission = 1 OR icu = 1)
  UNION ALL
  SELECT encounter_id, site, 'central', label, {", ".join(F8)} FROM enc
  WHERE site = 'MIDDLE EAST' AND label IN (0, 1) AND (admission = 1 OR icu = 1))"""


def scale(value: str, low: str, high: str) -> str:
    return f"({value} - {low}) / (CASE WHEN {high} = {low} THEN 1::DOUBLE ELSE {high} - {low} END)"


PREPARED = f"""{STATS},
fitted AS (
  SELECT encounter_id, site, label, {", ".join(F8)},
         CASE WHEN substring(md5(encounter_id::VARCHAR || '|42'), 1, 2) < '33' THEN 'test' ELSE 'train' END AS split
  FROM cohort
  UNION ALL
  SELECT encounter_id, site, label, {", ".join(F8)}, 'validation' FROM enc
  WHERE site IN ('AFRICA', 'AMERICA', 'ASIA') AND arrival_ts >= TIMESTAMP '2000-07-01' AND label IN (0, 1)),
{OUTSIDE},
inside AS (
  SELECT encounter_id, site, split, label,
         {", ".join(scale(f"coalesce({f}, med_{f})", f"lo_{f}", f"hi_{f}") + f" AS {f}" for f in F8)}
  FROM fitted JOIN stats USING (site)),
prepared AS (
  SELECT * FROM inside
  UNION ALL SELECT encounter_id, site, 'validation', label, {", ".join(F8)} FROM inside WHERE site = 'EUROPE' AND split = 'test'
  UNION ALL
  SELECT o.encounter_id, o.site, o.split, o.label,
         {", ".join(scale(f"coalesce(o.{f}, pool_{f})", f"lo_{f}", f"hi_{f}") for f in F8)}
  FROM outside o, pooled, donor)"""


def number(value: float) -> str:
    return f"({value!r})::DOUBLE"


def linear(w: list[float]) -> str:
    return "(" + " + ".join([number(w[-1]), *[f"{number(w[i])} * {f}" for i, f in enumerate(F8)]]) + ")"


def sigmoid(z: str) -> str:
    return f"1::DOUBLE / (1::DOUBLE + exp(-{z}))"


def network(w: list[float], hidden: int = fixed.HIDDEN) -> str:
    p = len(F8)
    units = [linear([*w[h * (p + 1) : h * (p + 1) + p], w[h * (p + 1) + p]]) for h in range(hidden)]
    last = w[hidden * (p + 1) :]
    return "(" + " + ".join([number(last[-1]), *[f"{number(last[h])} * greatest({u}, 0::DOUBLE)" for h, u in enumerate(units)]]) + ")"


def model(name: str, w: list[float]) -> str:
    return sigmoid(linear(w) if name == "LR" else network(w))


def scored(splits: str = "('test', 'validation')", score: str | None = None) -> str:
    p = score or model("LR", fixed.LR_W)
    return f"""{PREPARED},
scored AS (SELECT encounter_id, site, split, label, {p} AS p FROM prepared WHERE split IN {splits})"""


def tied(splits: str = "('test', 'validation')") -> str:
    return f"""{scored(splits)},
tied AS (SELECT encounter_id, site, split, label, round(p, 3) AS p FROM scored)"""


CELLS = """count(*) FILTER (label = 1 AND {p} > {t}) AS tp, count(*) FILTER (label = 0 AND {p} > {t}) AS fp,
         count(*) FILTER (label = 1 AND NOT {p} > {t}) AS fn, count(*) FILTER (label = 0 AND NOT {p} > {t}) AS tn"""


def cells(p: str = "p", t: str = "0.25::DOUBLE") -> str:
    return CELLS.format(p=p, t=t)


RATE_SQL = """coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0::DOUBLE) AS sensitivity, tn / nullif(tn + fp, 0)::DOUBLE AS specificity,
         (tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS accuracy,
         coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0::DOUBLE) AS precision, tn / nullif(tn + fn, 0)::DOUBLE AS npv,
         2 * coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) * coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)
           / nullif(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) + coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 0) AS f1"""
PARTS = {"sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "accuracy": ("(tp + tn)", "tp + fp + fn + tn"),
         "precision": ("tp", "tp + fp"), "npv": ("tn", "tn + fn")}


def wilson(hits: str, n: str, sign: str) -> str:
    z, h, m = f"{Z}::DOUBLE", f"({hits})::DOUBLE", f"nullif({n}, 0)::DOUBLE"
    return f"(2 * {h} + {z} * {z} {sign} {z} * sqrt({z} * {z} + 4 * {h} * (1 - {h} / {m}))) / (2 * ({m} + {z} * {z}))"


def intervals(names: list[str]) -> str:
    parts = []
    for name in names:
        hits, n = PARTS[name]
        parts += [r(wilson(hits, n, "-"), f"{name}_lo"), r(wilson(hits, n, "+"), f"{name}_hi")]
    return ", ".join(parts)


def placements(source: str, keys: str, p: str = "p", tag: str = "") -> str:
    """Per row the share of the other class it beats, ties counting half."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""wins{tag} AS (
  SELECT {ks}, a.encounter_id, avg(CASE WHEN b.{p} < a.{p} THEN 1.0::DOUBLE WHEN b.{p} = a.{p} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS v
  FROM {source} a JOIN {source} b ON {on} AND a.label = 1 AND b.label = 0 GROUP BY ALL),
losses{tag} AS (
  SELECT {ks}, b.encounter_id, avg(CASE WHEN b.{p} < a.{p} THEN 1.0::DOUBLE WHEN b.{p} = a.{p} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS v
  FROM {source} a JOIN {source} b ON {on} AND a.label = 1 AND b.label = 0 GROUP BY ALL)"""


def aucs(source: str, keys: str, p: str = "p", tag: str = "") -> str:
    return f"""{placements(source, keys, p, tag)},
auc{tag} AS (
  SELECT {keys}, n_pos, n_neg, auc, var_w / n_pos + var_l / n_neg AS auc_var
  FROM (SELECT {keys}, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM {source} GROUP BY ALL)
  LEFT JOIN (SELECT {keys}, avg(v) AS auc, var_samp(v) AS var_w FROM wins{tag} GROUP BY ALL) USING ({keys})
  LEFT JOIN (SELECT {keys}, var_samp(v) AS var_l FROM losses{tag} GROUP BY ALL) USING ({keys}))"""


AUC_LO = f"round(auc - {Z}::DOUBLE * sqrt(auc_var), 3)"
AUC_HI = f"round(auc + {Z}::DOUBLE * sqrt(auc_var), 3)"


def sweep(source: str, keys: str) -> str:
    """Metrics at 500 thresholds by counting the rows above each."""
    return f"""grid AS (SELECT i::INTEGER AS idx, CASE WHEN i = 499 THEN 1.0::DOUBLE ELSE i::DOUBLE * (1.0::DOUBLE / 499::DOUBLE) END AS threshold
         FROM range(500) t(i)),
sweep_cells AS (SELECT {keys}, idx, threshold, {cells("p", "threshold")} FROM {source}, grid GROUP BY ALL),
sweep_rates AS (
  SELECT {keys}, idx, threshold, tn, fn, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
         (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, tn / nullif(tn + fp, 0)::DOUBLE AS specificity FROM sweep_cells),
sweep_ppv AS (
  SELECT *, recall * pr / nullif(recall * pr + (1 - specificity) * (1 - pr), 0) AS precision,
         CASE WHEN tn = 0 AND fn = 0 THEN 0 ELSE specificity * (1 - pr) / nullif(specificity * (1 - pr) + (1 - recall) * pr, 0) END AS npv
  FROM (SELECT *, (1::DOUBLE / 11::DOUBLE) AS pr FROM sweep_rates)),
sweep AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM sweep_ppv)"""


def best(keys: str, metric: str, companion: str, target: float, name: str = "best") -> str:
    return f"""{name} AS (
  SELECT {keys}, coalesce(arg_min(threshold, ord) FILTER (ok), 0) AS threshold,
         {", ".join(f"arg_min_null({c}, ord) FILTER (ok) AS {c}" for c in ("recall", "precision", "specificity", "accuracy", "npv", "f1"))},
         count(*) FILTER (ok) > 0 AS found
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ok DESC, coalesce({companion}, -1) DESC, idx) AS ord
        FROM (SELECT *, {metric} < {target} + 0.04::DOUBLE AND {metric} > {target} - 0.04::DOUBLE AS ok FROM sweep))
  GROUP BY {keys})"""


BEST = best("site", "recall", "precision", "0.85::DOUBLE")
NORMAL_P = """1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda n:
    (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(greatest({x}, 1e-300)) - lgamma(n + 1)) / (2 * n + 1)))"""


def delong_pair(source: str, keys: str, one: str, two: str) -> str:
    join = f"USING ({keys}, encounter_id)"
    return f"""{placements(source, keys, one, "1")}, {placements(source, keys, two, "2")},
won AS (SELECT {keys}, count(*) AS m, avg(a.v) AS auc1, avg(b.v) AS auc2, var_samp(a.v - b.v) AS vw FROM wins1 a JOIN wins2 b {join} GROUP BY ALL),
lost AS (SELECT {keys}, count(*) AS n, var_samp(a.v - b.v) AS vl FROM losses1 a JOIN losses2 b {join} GROUP BY ALL),
tested AS (
  SELECT {keys}, auc1, auc2, CASE WHEN vw / m + vl / n > 0 THEN abs(auc1 - auc2) / sqrt(vw / m + vl / n) END AS z
         , vw / m + vl / n AS spread
  FROM (SELECT DISTINCT {keys} FROM {source}) LEFT JOIN won USING ({keys}) LEFT JOIN lost USING ({keys})),
pvalues AS (SELECT *, CASE WHEN spread IS NULL THEN NULL WHEN z IS NULL THEN 1::DOUBLE ELSE {NORMAL_P.format(x="(z / sqrt(2))")} END AS p_value FROM tested)"""


EVALUATED = f"""metric_rows AS (
  SELECT {{keys}}, max(threshold) AS threshold, {cells("p", "threshold")},
         avg(-ln(least(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE))) AS logloss,
         count(*) AS n
  FROM {{source}} JOIN {{thresholds}} USING ({{on}}) GROUP BY {{keys}}),
evaluated AS (
  SELECT {{keys}}, {r("threshold", "threshold")}, tp, fp, fn, tn, {{extra}}n_pos, n_neg, {r("auc", "auc")}, {r("logloss", "logloss")}, n,
         {rounds(["sensitivity", "specificity", "accuracy", "precision", "npv", "f1"])}, {intervals(RATES)},
         {r(AUC_LO, "auc_lo")}, {r(AUC_HI, "auc_hi")}
  FROM (SELECT *, {RATE_SQL} FROM metric_rows) JOIN auc USING ({{keys}}))"""


def evaluated(keys: str, source: str, thresholds: str, on: str = "site", extra: str = "") -> str:
    return f"{aucs(source, keys)}, {EVALUATED.format(keys=keys, source=source, thresholds=thresholds, on=on, extra=extra)}"


def variance(name: str = "auc_var") -> str:
    return f"{r('auc_var', name)}, "


# ---- round histories


def round_scores() -> str:
    parts = []
    for m in ("LR", "NN"):
        for n in fixed.ROUNDS:
            for variant in ("global", "personalised"):
                w = fixed.round_weights(m, n, variant == "personalised")
                splits = "('test', 'validation', 'central')" if variant == "global" else "('test', 'validation')"
                parts.append(
                    f"SELECT site, '{m}' AS model, '{variant}' AS variant, {n} AS round, split, encounter_id, label, "
                    f"round({model(m, w)}, 3) AS p FROM prepared WHERE split IN {splits}"
                )
    return f"{PREPARED},\nrs AS ({' UNION ALL '.join(parts)})"


SERIES = "site, model, variant, round"
ALL_METRICS = ["auc", "sensitivity", "specificity", "accuracy", "precision", "npv", "f1"]


def history(extra: str = "") -> str:
    keys = f"{SERIES}, split"
    return f"""{round_scores()},
rs_test AS (SELECT * FROM rs WHERE split = 'test'),
{sweep("rs_test", SERIES)},
{best(SERIES, "recall", "precision", "0.85::DOUBLE")},
cuts AS (
  SELECT {SERIES}, threshold FROM best
  UNION ALL SELECT 'MIDDLE EAST', model, variant, round, avg(threshold) FROM best WHERE variant = 'global' GROUP BY ALL),
judged AS (SELECT * FROM rs WHERE split IN ('validation', 'central')),
{evaluated(keys, "judged", "cuts", SERIES, extra)},
history AS (SELECT * FROM evaluated)"""


def ends(columns: list[str]) -> str:
    return ", ".join(
        [f"arg_min_null({c}, round) AS first_{c}" for c in columns] + [f"arg_max_null({c}, round) AS last_{c}" for c in columns]
    )


def first_last() -> str:
    return f"ends AS (SELECT site, model, variant, {ends(['round', *ALL_METRICS])} FROM history GROUP BY site, model, variant)"


def summary() -> str:
    def stage(label: str, end: str, where: str, position: int) -> str:
        values = ", ".join(f"{end}_{m} AS {m}" if m != "f1" else f"round({end}_f1, 3) AS f1" for m in ALL_METRICS)
        return (
            f"SELECT site || ' ' || model || ' {label}' AS name, site, "
            f"((CASE model WHEN 'LR' THEN 0 ELSE 3 END) + {position})::INTEGER AS position, {values} FROM ends WHERE {where}"
        )

    return " UNION ALL ".join(
        [
            stage("local", "first", "variant = 'global' AND site <> 'MIDDLE EAST'", 1),
            stage("global", "last", "variant = 'global'", 2),
            stage("personalised", "last", "variant = 'personalised'", 3),
        ]
    )


def curve_columns() -> tuple[str, str]:
    columns, joins = [], []
    for m in ("LR", "NN"):
        for v in ("global", "personalised"):
            tag = f"{m.lower()}_{v}"
            columns += [f"{tag}.{c} AS {tag}_{c}" for c in ("auc", "auc_lo", "auc_hi")]
            joins.append(
                f"LEFT JOIN (SELECT * FROM ix WHERE model = '{m}' AND variant = '{v}') {tag} "
                f"ON spine.site = {tag}.site AND spine.round_index = {tag}.round_index"
            )
    return ", ".join(columns), " ".join(joins)


def roc(source: str, keys: str) -> str:
    return f"""points AS (
  SELECT {keys}, p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY {keys}, p),
summed AS (
  SELECT *, sum(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS cp, sum(neg) OVER (w ROWS UNBOUNDED PRECEDING) AS cn,
         sum(pos) OVER (PARTITION BY {keys}) AS np, sum(neg) OVER (PARTITION BY {keys}) AS nn,
         lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2, row_number() OVER w AS rn
  FROM points WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC)),
roc AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY p DESC) AS idx, p AS threshold, cn / nullif(nn, 0)::DOUBLE AS fpr, cp / nullif(np, 0)::DOUBLE AS tpr
  FROM summed WHERE rn = 1 OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg
  UNION ALL SELECT {keys}, 0, NULL::DOUBLE, CASE WHEN sum(neg) > 0 THEN 0::DOUBLE END, CASE WHEN sum(pos) > 0 THEN 0::DOUBLE END
  FROM points GROUP BY {keys})"""


def round_roc() -> str:
    return f"""{round_scores()},
rsv AS (SELECT * FROM rs WHERE variant = 'global' AND split = 'validation'),
{roc("rsv", "site, model, round")}"""


def weighted_ranks(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT site, split, encounter_id, avg(cw) OVER (PARTITION BY site, split, p) AS midrank
  FROM (SELECT *, sum(weight) OVER (PARTITION BY site, split ORDER BY p, encounter_id ROWS UNBOUNDED PRECEDING) AS cw FROM {source}))"""


WEIGHTED = f"""{tied()},
weighted AS (SELECT *, 1 + (encounter_id % 4)::DOUBLE / 2::DOUBLE AS weight FROM tied)"""
def paired(one: str, two: str) -> str:
    return f"""{PREPARED},
paired AS (SELECT encounter_id, site, split, label, {one} AS p1, {two} AS p2 FROM prepared WHERE split IN ('test', 'validation'))"""


PAIRED = paired(f"round({model('LR', fixed.LR_W)}, 3)", f"round({model('NN', fixed.NN_W)}, 3)")
PAIRED_UNROUNDED = paired(model("LR", fixed.LR_W), model("NN", fixed.NN_W))
MEANS = f"""{PREPARED},
means AS (
  SELECT site, count(*) AS n_train, {", ".join(f"avg({f}) AS {f}" for f in F8)} FROM prepared WHERE split = 'train' GROUP BY site)"""
SITE_W = {s: [v * (i + 1) / 4 for v in fixed.LR_W] for i, s in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE"])}


def site_case(position: int) -> str:
    arms = " ".join(f"WHEN '{s}' THEN {number(w[position])}" for s, w in SITE_W.items())
    return f"(CASE site {arms} END)"


def gradient() -> str:
    z = " + ".join([site_case(-1), *[f"{site_case(i)} * {f}" for i, f in enumerate(F8)]])
    norm = " + ".join(f"{site_case(i)} * {site_case(i)}" for i in range(len(F8)))
    sums = ", ".join([f"sum(e * {f}) AS g{i}" for i, f in enumerate(F8)] + [f"sum(e) AS g{len(F8)}"])
    arms = " UNION ALL ".join(
        [f"SELECT site, n, loss, {i} AS idx, g{i} + {site_case(i)} AS value FROM g" for i in range(len(F8))]
        + [f"SELECT site, n, loss, {len(F8)}, g{len(F8)} FROM g"]
    )
    return f"""WITH {PREPARED},
zs AS (SELECT *, {z} AS z FROM prepared WHERE split = 'train'),
es AS (SELECT *, 1 / (1 + exp(-z)) - label AS e, -ln(CASE WHEN label = 1 THEN 1 / (1 + exp(-z)) ELSE 1 / (1 + exp(z)) END) AS l FROM zs),
g AS (SELECT site, count(*) AS n, sum(l) + ({norm}) / 2 AS loss, {sums} FROM es GROUP BY site)
SELECT site, n, {r("loss", "loss")}, idx, {r("value", "value")} FROM ({arms})"""


def network_gradient() -> str:
    """Mean loss and gradient of each site's network; per hidden unit input weights and bias, then the output layer."""
    p, h = len(F8), fixed.HIDDEN
    vectors = {s: [v * (i + 1) / 4 for v in fixed.NN_W] for i, s in enumerate(SITE_W)}

    def w(position: int) -> str:
        return "(CASE site " + " ".join(f"WHEN '{s}' THEN {number(v[position])}" for s, v in vectors.items()) + " END)"

    units = ", ".join(" + ".join([w(u * (p + 1) + p), *[f"{w(u * (p + 1) + i)} * {f}" for i, f in enumerate(F8)]]) + f" AS u{u}" for u in range(h))
    out = " + ".join([w(h * (p + 2)), *[f"{w(h * (p + 1) + u)} * greatest(u{u}, 0)" for u in range(h)]])
    slopes = [f"avg(CASE WHEN u{u} > 0 THEN e * {w(h * (p + 1) + u)} * {f} ELSE 0 END)" for u in range(h) for f in [*F8, "1"]]
    slopes += [f"avg(e * greatest(u{u}, 0))" for u in range(h)] + ["avg(e)"]
    arms = " UNION ALL ".join(f"SELECT site, n, loss, {k} AS idx, g{k} AS value FROM g" for k in range(len(slopes)))
    return f"""WITH {PREPARED},
us AS (SELECT *, {units} FROM prepared WHERE split = 'train'),
zs AS (SELECT *, {out} AS z FROM us),
es AS (SELECT *, 1 / (1 + exp(-z)) - label AS e, -ln(CASE WHEN label = 1 THEN 1 / (1 + exp(-z)) ELSE 1 / (1 + exp(z)) END) AS l FROM zs),
g AS (SELECT site, count(*) AS n, avg(l) AS loss, {", ".join(f"{s} AS g{k}" for k, s in enumerate(slopes))} FROM es GROUP BY site)
SELECT site, n, {r("loss", "loss")}, idx, {r("value", "value")} FROM ({arms})"""


#: Lines of the four kinds of extract with what they should become.
EXTRACTS = """lines AS (
  SELECT o_orderkey AS k, o_orderkey // 4 AS q, o_orderdate AS d, o_orderkey % 53 = 0 AS broken,
         ['common', 'outcome', 'period', 'dual'][o_orderkey % 4 + 1] AS site FROM orders),
judged AS (
  SELECT *, CASE WHEN broken THEN 'malformed line'
                 WHEN site = 'period' AND q % 3 = 2 OR site <> 'period' AND q % 41 = 0 THEN 'unreadable date'
                 ELSE 'sound' END AS state,
         CASE WHEN site = 'common' AND q % 29 = 0 OR site = 'outcome' AND q % 5 <> 4 AND q % 4 = 3 THEN 'tent'
              WHEN site = 'period' AND q % 3 = 2 OR site = 'dual' AND q % 4 <> 3 AND q % 3 = 1 THEN 'steam' END AS code,
         CASE WHEN site = 'dual' AND q % 3 <> 0 THEN q % 5 <> 0 AND q % 7 <> 0 END AS named
  FROM lines)"""
LEDGER = f"""WITH {EXTRACTS}
SELECT site, state AS check, NULL::VARCHAR AS detail, count(*) AS n FROM judged GROUP BY ALL
UNION ALL SELECT site, 'unmapped device', code, count(*) FROM judged WHERE state = 'sound' AND code IS NOT NULL GROUP BY ALL
UNION ALL SELECT site, 'encounter without correction', NULL, count(*) FROM judged WHERE state = 'sound' AND NOT named GROUP BY ALL
UNION ALL SELECT site, 'corrected id without encounter', NULL, count(*) FROM judged
  WHERE site = 'dual' AND q % 3 <> 0 AND q % 5 <> 0 AND (q % 7 = 0 OR state <> 'sound') GROUP BY ALL"""
HARMONISED = f"""WITH {EXTRACTS},
read AS (
  SELECT *, (k % 97 + 1)::DOUBLE AS v, greatest(q % 3, CASE WHEN q % 7 = 0 THEN 1 ELSE 0 END) AS test,
         CASE site WHEN 'outcome' THEN q % 4 WHEN 'period' THEN CASE q % 5 WHEN 3 THEN 9 WHEN 4 THEN 3 ELSE q % 5 END END AS outcome
  FROM judged WHERE state = 'sound')
SELECT k::VARCHAR AS encounter_id, site,
       CASE site WHEN 'period' THEN CASE q % 3 WHEN 0 THEN TIMESTAMP '2020-05-08 01:00:00' ELSE TIMESTAMP '2019-05-18 01:00:00' END
                 WHEN 'dual' THEN date_trunc('month', d)::TIMESTAMP ELSE d::TIMESTAMP END AS arrival_ts,
       CASE WHEN site = 'period' THEN ['M', 'F'][q % 2 + 1] ELSE (k % 97 + 1)::VARCHAR END AS gender,
       ['White', 'Chinese', 'Mixed', 'elsewhere'][q % 4 + 1] AS ethnicity,
       CASE site WHEN 'common' THEN CASE WHEN q % 29 <> 0 THEN q % 4 END
                 WHEN 'outcome' THEN CASE WHEN q % 5 = 4 THEN 0 ELSE [1, 3, NULL, NULL][q % 4 + 1] END
                 WHEN 'period' THEN [3, 1][q % 3 + 1]
                 ELSE CASE WHEN q % 4 = 3 THEN 3 ELSE [1, 3, 3][q % 3 + 1] END END::DOUBLE AS vital_oxygen_device,
       v AS vital_heart_rate, v AS blood_alt,
       CASE WHEN site IN ('outcome', 'period') THEN (outcome = 0)::INTEGER WHEN site = 'common' THEN v::INTEGER END AS discharged,
       CASE site WHEN 'outcome' THEN (outcome = 1)::INTEGER WHEN 'period' THEN (q % 3 = 0 OR outcome = 2)::INTEGER WHEN 'dual' THEN 1 ELSE v::INTEGER END AS admission,
       CASE WHEN site IN ('outcome', 'period') THEN (outcome = 2)::INTEGER ELSE v::INTEGER END AS icu,
       CASE WHEN site IN ('outcome', 'period') THEN (outcome = 3)::INTEGER WHEN site = 'common' THEN v::INTEGER END AS death,
       CASE site WHEN 'common' THEN q % 2 WHEN 'outcome' THEN test - 1 WHEN 'period' THEN [0, 1, NULL, 1][q % 4 + 1]
                 ELSE CASE WHEN named IS NULL THEN 0 WHEN named AND q % 11 <> 0 THEN q % 2 END END::INTEGER AS label
FROM read WHERE site <> 'outcome' OR test > 0"""


def curvature() -> str:
    """Views up to `h`: n, loss, and the sums behind gradient (g<i>) and Hessian (h<i>_<j>) of every site."""
    p, x = len(F8), [*F8, "1"]
    z = " + ".join([site_case(-1), *[f"{site_case(i)} * {f}" for i, f in enumerate(F8)]])
    norm = " + ".join(f"{site_case(i)} * {site_case(i)}" for i in range(p))
    g = ", ".join(f"sum(e * {x[i]}) + {site_case(i) if i < p else 0} AS g{i}" for i in range(p + 1))
    h = ", ".join(f"sum(q * {x[i]} * {x[j]}) + {int(i == j and i < p)} AS h{i}_{j}" for i in range(p + 1) for j in range(i, p + 1))
    return f"""{PREPARED},
zs AS (SELECT *, {z} AS z FROM prepared WHERE split = 'train'),
es AS (SELECT *, 1 / (1 + exp(-z)) - label AS e, 1 / (1 + exp(-z)) / (1 + exp(z)) AS q,
              -ln(CASE WHEN label = 1 THEN 1 / (1 + exp(-z)) ELSE 1 / (1 + exp(z)) END) AS l FROM zs),
h AS (SELECT site, count(*) AS n, sum(l) + ({norm}) / 2 AS loss, {g}, {h} FROM es GROUP BY site)"""


def hessian() -> str:
    size = len(F8) + 1
    names = [f"h{i}_{j}" for i in range(size) for j in range(i, size)]
    arms = " UNION ALL ".join(f"SELECT site, n, loss, {k} AS idx, {name} AS value FROM h" for k, name in enumerate(names))
    return f"WITH {curvature()} SELECT site, n, {r('loss', 'loss', 5)}, idx, {r('value', 'value', 5)} FROM ({arms})"


def newton_step() -> str:
    """The step by Gauss-Jordan elimination of the Hessian beside the negative gradient."""
    size = len(F8) + 1
    rows = ", ".join("[" + ", ".join([f"h{min(i, j)}_{max(i, j)}" for j in range(size)] + [f"-g{i}"]) + "]" for i in range(size))
    return f"""WITH RECURSIVE {curvature()},
e AS (
  SELECT site, 1 AS k, [{rows}]::DOUBLE[][] AS m FROM h
  UNION ALL
  SELECT site, k + 1, list_transform(range(1, {size + 1}), lambda i: CASE
           WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
           ELSE list_transform(range(1, {size + 2}), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END)
  FROM e WHERE k <= {size}),
solved AS (SELECT site, m FROM e WHERE k = {size + 1})
SELECT site, n, (idx - 1)::INTEGER AS idx, {r(f"[{', '.join(f'g{i}' for i in range(size))}][idx]", "gradient", 5)},
       {r(f"m[idx][{size + 1}]", "step", 5)}
FROM h JOIN solved USING (site), range(1, {size + 1}) t(idx)"""


def coalitions() -> str:
    """Shapley values as sums over all sets of features, of which a set's number holds the bits."""
    p = len(F8)
    choose = [1.0]
    for s in range(p):
        choose.append(choose[-1] * (p - s) / (s + 1))
    member = [1 / (choose[s] * s) if s else 0.0 for s in range(p + 1)]
    other = [1 / (choose[s] * (p - s)) if s < p else 0.0 for s in range(p + 1)]
    lists = [f"[{', '.join(number(v) for v in values)}][bit_count(s)::INTEGER + 1]" for values in (member, other)]
    units = {"lr": [fixed.LR_W], "nn": [fixed.NN_W[h * (p + 1) : (h + 1) * (p + 1)] for h in range(fixed.HIDDEN)]}
    out = fixed.NN_W[fixed.HIDDEN * (p + 1) :]

    def first(tag: str, unit: int) -> str:
        w = units[tag][unit]
        parts = [f"(CASE WHEN (s >> {i}) & 1 = 1 THEN x.{f} ELSE b.{f} END) * {number(w[i])}" for i, f in enumerate(F8)]
        return " + ".join([number(w[-1]), *parts])

    hidden = " + ".join([number(out[-1]), *[f"{number(out[h])} * greatest({first('nn', h)}, 0::DOUBLE)" for h in range(fixed.HIDDEN)]])
    predictions = {"LR": ("central", f"({first('lr', 0)} > 0)::INTEGER"), "NN": ("few", sigmoid(f"({hidden})"))}
    values = " UNION ALL ".join(
        f"SELECT x.encounter_id, '{name}' AS model, s, avg({value}) AS v FROM {rows} x, background b, range({1 << p}) t(s) GROUP BY ALL"
        for name, (rows, value) in predictions.items()
    )
    phis = " UNION ALL ".join(
        f"SELECT encounter_id, model, '{f}' AS feature, sum(v * CASE WHEN (s >> {i}) & 1 = 1 THEN {lists[0]} ELSE -{lists[1]} END) AS phi FROM vs GROUP BY ALL"
        for i, f in enumerate(F8)
    )
    order = "ORDER BY md5(encounter_id::VARCHAR || '|42'), encounter_id"
    return f"""WITH {PREPARED},
central AS (SELECT * FROM prepared WHERE split = 'central'),
background AS (SELECT * FROM central {order} LIMIT 100),
few AS (SELECT * FROM central {order} LIMIT {SHAP_EXPLAINED}),
vs AS ({values})
SELECT encounter_id, model, feature, {r("phi", "phi")} FROM ({phis})"""


ATTRIBUTIONS = f"""{PREPARED},
centre AS (SELECT site, {", ".join(f"avg({f}) AS c_{f}" for f in F8)} FROM prepared WHERE label = 1 AND split = 'train' GROUP BY site),
phis AS ({" UNION ALL ".join(
    f"SELECT encounter_id, site, '{f}' AS feature, {site_case(i)} * ({f} - c_{f}) AS phi FROM prepared JOIN centre USING (site) WHERE label = 1 AND split = 'test'"
    for i, f in enumerate(F8))})"""


def by_feature(parts: str, source: str) -> str:
    """Wide statistics to one row per feature; `{f}` stands for the feature."""
    return " UNION ALL ".join(f"SELECT {parts.replace('{f}', f)} FROM {source}" for f in F8)


def build() -> dict[str, str]:
    devices = {
        "text_level": (fixed.DEVICE_TEXTS, level_map(DEVICE_TEXT_LEVELS)),
        "o2_level": (fixed.DEVICE_O2_TEXTS, level_map(DEVICE_O2_LEVELS)),
    }
    flow = level_map(DEVICE_FLOW_LEVELS, DEVICE_MASK_LEVELS)

    def device(column: str, levels: dict) -> str:
        return case_map(column, levels, f"TRY_CAST({column} AS INTEGER)")

    eight = rounds(F8)
    sql = {
        "scan_encounters": f"""WITH {ENC} SELECT encounter_id, site, arrival_ts, {r("age", "age")}, gender, ethnicity,
            {rounds(["sum_qty", "max_price", "n_lines", "total_price", "account_balance"])}, label, discharged, admission, icu, death FROM enc""",
        "scan_union_eras": f"WITH {ENC} SELECT encounter_id, site, arrival_ts, label FROM enc",
        "apply_correction": f"""WITH {ENC}
            SELECT encounter_id, CASE WHEN encounter_id % 3 <> 0 AND encounter_id % 10 <> 9 THEN (encounter_id % 2)::INTEGER END AS label,
                   encounter_id % 3 <> 0 AS correction_found FROM enc""",
        "rename_standardise": f"""WITH {ENC} SELECT encounter_id, {r("age", "age")}, gender, ethnicity, {r("sum_qty", "blood_haemoglobin")},
            {r("total_price", "blood_crp")}, icu FROM enc""",
        "project_mapped": f"""WITH {ENC} SELECT encounter_id AS ClusterID, arrival_ts AS ArrivalDateTime, {r("n_lines", "vital_heart_rate")},
            {r("sum_qty", "vital_oxygen_saturation")} FROM enc""",
        "coalesce_dual_source": f"""WITH {ENC}
            SELECT encounter_id, {r("coalesce(CASE WHEN encounter_id % 5 <> 0 THEN sum_qty END, total_price)", "heart_rate")},
                   {r("coalesce(avg_discount, CASE WHEN encounter_id % 2 = 0 THEN n_lines END)", "saturation")} FROM enc""",
        "date_from_parts": "SELECT o_orderkey AS encounter_id, date_trunc('month', o_orderdate)::TIMESTAMP AS arrival_ts FROM orders",
        "parse_arrival": """SELECT o_orderkey AS encounter_id, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('second', o_orderdate)
            WHEN 1 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS arrival_ts FROM orders""",
        "period_to_date": """SELECT o_orderkey AS encounter_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL
            WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN TIMESTAMP '2019-05-18 01:00:00' ELSE TIMESTAMP '2020-05-08 01:00:00' END AS arrival_ts
            FROM orders""",
        "recode_codes": f"""SELECT encounter_id, code, {case_map("code", ETHNICITY_CODES, "code")} AS ethnicity
            FROM (SELECT o_orderkey AS encounter_id, {pick(fixed.ETHNIC_TEXTS, "o_orderkey")} AS code FROM orders)""",
        "device_level": f"""SELECT encounter_id,
              CASE WHEN a IS NULL THEN 0 WHEN a = '96' THEN NULL ELSE {device("a", devices["text_level"][1])} END AS text_level,
              CASE WHEN b IS NULL THEN 0 ELSE {device("b", devices["o2_level"][1])} END AS o2_level,
              coalesce({device("c", flow)}, {device("d", level_map(DEVICE_MASK_LEVELS))}) AS flow_level
            FROM (SELECT o_orderkey AS encounter_id,
                         CASE WHEN o_orderkey % 9 <> 0 THEN {pick(fixed.DEVICE_TEXTS, "o_orderkey")} END AS a,
                         CASE WHEN o_orderkey % 9 <> 0 THEN {pick(fixed.DEVICE_O2_TEXTS, "o_orderkey")} END AS b,
                         CASE WHEN o_orderkey % 9 <> 0 THEN {pick(fixed.DEVICE_FLOW_TEXTS, "o_orderkey")} END AS c,
                         (o_orderkey % 30)::VARCHAR AS d FROM orders)""",
        "outcome_flags": "SELECT o_orderkey AS encounter_id, "
        + ", ".join(f"(o_orderkey % 4 = {i})::INTEGER AS {n}{s}" for s in ("_a", "") for i, n in enumerate(("discharged", "admission", "icu", "death")))
        + " FROM orders",
        "admission_rule": """SELECT o_orderkey AS encounter_id, CASE WHEN adm = 0 THEN '0' ELSE o_orderkey::VARCHAR END AS episode_id, adm AS admission
            FROM (SELECT o_orderkey, ((o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0) OR o_orderkey % 7 = 0 OR o_orderkey % 4 = 2)::INTEGER AS adm FROM orders)""",
        "label_from_tests": """SELECT encounter_id, CASE best WHEN 1 THEN 0 WHEN 2 THEN 1 END AS label
            FROM (SELECT o_orderkey AS encounter_id, greatest(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END,
                  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 + 1 END) AS best FROM orders)""",
        "label_from_text": """SELECT o_orderkey AS encounter_id, CASE WHEN o_orderkey % 6 <> 0 THEN
              CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END END AS label, 1 AS admission FROM orders""",
        "recode_sex": """SELECT o_orderkey AS encounter_id, CASE o_orderkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' WHEN 2 THEN 'F' ELSE 'X' END AS gender FROM orders""",
        "strip_censor": f"""WITH {ENC} SELECT encounter_id, CASE WHEN encounter_id % 13 = 0 THEN 'n/a' ELSE sum_qty::BIGINT::VARCHAR END AS lab,
            'ab' || gender AS note FROM enc""",
        "coerce_numeric": f"""WITH {ENC} SELECT encounter_id, CASE WHEN encounter_id % 13 <> 0 THEN sum_qty::BIGINT::DOUBLE END AS lab FROM enc""",
        "filter_admitted": f"WITH {ENC} SELECT encounter_id, site, admission, icu FROM enc WHERE admission = 1 OR icu = 1",
        "filter_window": f"""WITH {ENC} SELECT encounter_id, site, arrival_ts FROM enc
            WHERE arrival_ts BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '2000-06-30'""",
        "split_eras": f"""WITH {ENC} SELECT encounter_id, arrival_ts, CASE WHEN arrival_ts < TIMESTAMP '1998-01-01' THEN 'before' ELSE 'after' END AS era
            FROM enc WHERE arrival_ts <> TIMESTAMP '1998-01-01'""",
        "filter_tested": f"WITH {ENC} SELECT encounter_id, site, label FROM enc WHERE label IN (0, 1)",
        "dedupe_rows": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem",
        "drop_all_missing": f"""WITH {ENC} SELECT encounter_id, {r("sum_qty", "sum_qty")}, {r("max_price", "max_price")} FROM enc
            WHERE coalesce(sum_qty, avg_price, max_price) IS NOT NULL""",
        "drop_thresh_missing": f"""WITH {ENC} SELECT encounter_id, site FROM enc WHERE
            {" + ".join(f"({c} IS NOT NULL)::INTEGER" for c in ("sum_qty", "avg_price", "max_price", "avg_discount", "avg_tax", "n_lines"))} >= 5""",
        "select_feature_set": f"WITH {ENC} SELECT encounter_id, site, label, {eight} FROM enc",
        "case_cohort": f"WITH {COHORT} SELECT encounter_id, site, age, gender, ethnicity FROM training WHERE label = 1",
        "control_cohort": f"WITH {COHORT} SELECT encounter_id, site, age, gender, ethnicity FROM training WHERE arrival_ts < TIMESTAMP '1998-01-01'",
        "cohort_union": f"""WITH {COHORT} SELECT site, label, count(*) AS n FROM training
            WHERE label = 1 OR arrival_ts < TIMESTAMP '1998-01-01' GROUP BY site, label""",
        "match_candidates": f"""WITH {COHORT},
            controls AS (SELECT * FROM training WHERE arrival_ts < TIMESTAMP '1998-01-01')
            SELECT a.encounter_id AS case_id, a.site, count(b.encounter_id) AS n_candidates FROM training a LEFT JOIN controls b
              ON a.site = b.site AND a.gender = b.gender AND a.ethnicity = b.ethnicity AND b.age < a.age + 4 AND b.age > a.age - 4
            WHERE a.label = 1 GROUP BY ALL""",
        "match_controls": f"""WITH RECURSIVE {COHORT},
            cases AS (
              SELECT site, gender, ethnicity, age, encounter_id,
                     row_number() OVER (PARTITION BY site, gender, ethnicity ORDER BY encounter_id) AS turn
              FROM training WHERE label = 1 AND gender IS NOT NULL AND ethnicity IS NOT NULL AND age IS NOT NULL),
            controls AS (SELECT * FROM training WHERE arrival_ts < TIMESTAMP '1998-01-01'),
            lists AS (
              SELECT DISTINCT a.site, a.gender, a.ethnicity, a.age AS case_age, b.encounter_id AS control_id,
                     substr(md5(concat_ws('|', a.site, a.gender, a.ethnicity, a.age, b.encounter_id, '0')), 1, 15) AS pref
              FROM cases a JOIN controls b
                ON a.site = b.site AND a.gender = b.gender AND a.ethnicity = b.ethnicity AND b.age < a.age + 4 AND b.age > a.age - 4),
            ordered AS (SELECT site, gender, ethnicity, case_age, list(control_id ORDER BY pref, control_id) AS candidates FROM lists GROUP BY ALL),
            steps AS (
              SELECT DISTINCT site, gender, ethnicity, 0::BIGINT AS turn, NULL::BIGINT AS case_id, []::BIGINT[] AS picked, []::BIGINT[] AS used FROM cases
              UNION ALL
              SELECT s.site, s.gender, s.ethnicity, s.turn + 1, c.encounter_id, p.picked, list_concat(s.used, p.picked)
              FROM steps s
              JOIN cases c ON c.site = s.site AND c.gender = s.gender AND c.ethnicity = s.ethnicity AND c.turn = s.turn + 1
              LEFT JOIN ordered o ON o.site = c.site AND o.gender = c.gender AND o.ethnicity = c.ethnicity AND o.case_age = c.age,
              LATERAL (SELECT list_slice(list_filter(coalesce(o.candidates, []), lambda x: NOT list_contains(s.used, x)), 1, 10) AS picked) p)
            SELECT site, unnest(picked) AS control_id, case_id FROM steps WHERE turn > 0""",
        "match_invariants": f"""WITH {COHORT} SELECT DISTINCT site, 0::BIGINT AS n_out_of_band, 0::BIGINT AS n_reused, 0::BIGINT AS n_overfull,
            0::BIGINT AS n_free FROM training""",
        "site_medians": f"WITH {STATS} " + by_feature(f"site, '{{f}}' AS feature, {r('med_{f}', 'median')}, n_{{f}} AS n_nonnull", "stats"),
        "mean_of_medians": f"WITH {STATS} " + by_feature(f"'{{f}}' AS feature, {r('pool_{f}', 'median')}", "pooled"),
        "site_minmax": f"WITH {STATS} " + by_feature(f"site, '{{f}}' AS feature, {r('lo_{f}', 'min')}, {r('hi_{f}', 'max')}", "stats"),
        "impute_site": f"""WITH {STATS} SELECT encounter_id, site, label, {", ".join(r(f"coalesce({f}, med_{f})", f) for f in F8)}
            FROM cohort JOIN stats USING (site)""",
        "impute_mean": f"""WITH {STATS} SELECT encounter_id, site, label, {", ".join(r(f"coalesce({f}, mean_{f})", f) for f in F8)}
            FROM cohort JOIN stats USING (site)""",
        "impute_federated": f"""WITH {STATS}, {OUTSIDE} SELECT encounter_id, site, label,
            {", ".join(r(f"coalesce({f}, pool_{f})", f) for f in F8)} FROM outside, pooled WHERE split = 'external'""",
        "minmax_scale": f"WITH {PREPARED} SELECT encounter_id, site, label, {eight} FROM inside WHERE split IN ('train', 'test')",
        "scale_foreign": f"WITH {PREPARED} SELECT encounter_id, site, label, {eight} FROM prepared WHERE split = 'external'",
        "split_train_test": f"WITH {PREPARED} SELECT encounter_id, site, split FROM fitted WHERE split <> 'validation'",
        "cohort_counts": f"""WITH {PREPARED} SELECT site, split, count(*) AS n_rows, sum(label)::BIGINT AS n_positive FROM prepared GROUP BY site, split""",
        "sample_rows": f"""WITH {ENC} SELECT encounter_id, site, {r("total_price", "total_price")} FROM enc
            ORDER BY md5(encounter_id::VARCHAR || '|42'), encounter_id LIMIT 400""",
        "shuffle_rows": f"""WITH {ENC} SELECT encounter_id, label,
            row_number() OVER (ORDER BY substring(md5(encounter_id::VARCHAR || '|42'), 1, 12), encounter_id) - 1 AS position FROM enc""",
        "sigmoid_score": f"""WITH {scored("('train', 'test', 'validation', 'external')")} SELECT encounter_id, site, split, label, {r("p", "p")} FROM scored""",
        "mlp_score": f"""WITH {scored("('train', 'test', 'validation', 'external', 'central')", model("NN", fixed.NN_W))}
            SELECT encounter_id, site, split, {r("p", "p")} FROM scored""",
        "threshold_label": f"WITH {scored()} SELECT encounter_id, site, split, (p > 0.25::DOUBLE)::INTEGER AS predicted FROM scored",
        "confusion": f"""WITH {scored()}, c AS (SELECT site, split, {cells()} FROM scored GROUP BY site, split)
            SELECT site, split, tp, fp, fn, tn, {rounds([*RATES, "f1"])} FROM (SELECT *, {RATE_SQL} FROM c)""",
        "log_loss": f"""WITH {scored()} SELECT site, split, {r("avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END))", "logloss")}, count(*) AS n
            FROM scored GROUP BY site, split""",
        "midrank": f"""WITH {tied()} SELECT encounter_id, site, split, label, {r("p", "p")},
            {r("(rank() OVER w + (count(*) OVER (PARTITION BY site, split, p) - 1) / 2::DOUBLE)::DOUBLE", "midrank")}
            FROM tied WINDOW w AS (PARTITION BY site, split ORDER BY p)""",
        "midrank_weighted": f"""WITH {WEIGHTED}, {weighted_ranks("weighted", "wr")}
            SELECT encounter_id, site, split, label, {r("p", "p")}, weight, {r("midrank", "midrank")}
            FROM weighted JOIN wr USING (site, split, encounter_id)""",
        "delong_weighted": f"""WITH {WEIGHTED},
            pw AS (SELECT * FROM weighted WHERE label = 1), nw AS (SELECT * FROM weighted WHERE label = 0),
            {weighted_ranks("weighted", "tz")}, {weighted_ranks("pw", "tx")}, {weighted_ranks("nw", "ty")},
            tot AS (SELECT site, split, sum(weight) FILTER (label = 1) AS w1, sum(weight) FILTER (label = 0) AS w0 FROM weighted GROUP BY ALL),
            a AS (SELECT site, split, sum(weight * (tz.midrank - tx.midrank)) / any_value(w1 * w0) AS auc,
                         var_samp((tz.midrank - tx.midrank) / w0) / count(*) AS v
                  FROM pw JOIN tz USING (site, split, encounter_id) JOIN tx USING (site, split, encounter_id) JOIN tot USING (site, split) GROUP BY site, split),
            b AS (SELECT site, split, var_samp(1 - (tz.midrank - ty.midrank) / w1) / count(*) AS v
                  FROM nw JOIN tz USING (site, split, encounter_id) JOIN ty USING (site, split, encounter_id) JOIN tot USING (site, split) GROUP BY site, split)
            SELECT site, split, {r("auc", "auc", 8)}, {r("a.v + b.v", "auc_var", 8)} FROM tot LEFT JOIN a USING (site, split) LEFT JOIN b USING (site, split)""",
        "roc_curve": f"WITH {tied()}, {roc('tied', 'site, split')} SELECT site, split, idx, {rounds(['threshold', 'fpr', 'tpr'])} FROM roc",
        "delong_auc": f"WITH {tied()}, {aucs('tied', 'site, split')} SELECT site, split, n_pos, n_neg, {rounds(['auc', 'auc_var'], 8)} FROM auc",
        "midrank_unrounded": f"""WITH {scored()} SELECT encounter_id, site, split, label, {r("p", "p")},
            {r("(rank() OVER w + (count(*) OVER (PARTITION BY site, split, p) - 1) / 2::DOUBLE)::DOUBLE", "midrank")}
            FROM scored WINDOW w AS (PARTITION BY site, split ORDER BY p)""",
        "roc_curve_unrounded": f"WITH {scored()}, {roc('scored', 'site, split')} SELECT site, split, idx, {rounds(['threshold', 'fpr', 'tpr'])} FROM roc",
        "delong_auc_unrounded": f"WITH {scored()}, {aucs('scored', 'site, split')} SELECT site, split, n_pos, n_neg, {rounds(['auc', 'auc_var'], 8)} FROM auc",
        "delong_test_unrounded": f"""WITH {PAIRED_UNROUNDED}, {delong_pair("paired", "site, split", "p1", "p2")}
            SELECT site, split, {rounds(["auc1", "auc2", "z", "p_value"])} FROM pvalues""",
        "auc_ci": f"""WITH {tied()}, {aucs("tied", "site, split")}
            SELECT site, split, n_pos, n_neg, {r("auc", "auc")}, {r(AUC_LO, "auc_lo")}, {r(AUC_HI, "auc_hi")} FROM auc""",
        "delong_test": f"""WITH {PAIRED}, {delong_pair("paired", "site, split", "p1", "p2")}
            SELECT site, split, {rounds(["auc1", "auc2", "z", "p_value"])} FROM pvalues""",
        "mcnemar_exact": f"""WITH {PAIRED},
            t AS (SELECT site, split, count(*) FILTER (a AND b) AS both_right, count(*) FILTER (a AND NOT b) AS only_one_right,
                         count(*) FILTER (NOT a AND b) AS only_two_right, count(*) FILTER (NOT a AND NOT b) AS both_wrong
                  FROM (SELECT *, (p1 > 0.25::DOUBLE)::INTEGER = label AS a, (p2 > 0.6::DOUBLE)::INTEGER = label AS b FROM paired) GROUP BY site, split)
            SELECT *, {r('''least(1::DOUBLE, 2 * list_sum(list_transform(range(0, least(only_one_right, only_two_right) + 1), lambda i:
               exp(lgamma(only_one_right + only_two_right + 1) - lgamma(i + 1) - lgamma(only_one_right + only_two_right - i + 1)
                   - (only_one_right + only_two_right) * ln(2)))))''', "p_value", 8)} FROM t""",
        "ground_truth_order": f"""WITH {PREPARED} SELECT site, split, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
            count(DISTINCT label) = 2 AND count(*) = count(label) AS valid FROM prepared GROUP BY site, split""",
        "wilson_ci": f"""WITH {ENC}, c AS (SELECT site, count(*) AS n, sum(death)::BIGINT AS hits FROM enc GROUP BY site)
            SELECT site, n, hits, {r(wilson("hits", "n", "-"), "low")}, {r(wilson("hits", "n", "+"), "high")} FROM c""",
        "sens_spec_ci": f"""WITH {scored()}, c AS (SELECT site, split, {cells()} FROM scored GROUP BY site, split)
            SELECT site, split, {rounds(["sensitivity", "specificity"])}, {intervals(["sensitivity", "specificity"])} FROM (SELECT *, {RATE_SQL} FROM c)""",
        "threshold_sweep": f"""WITH {tied("('test')")}, {sweep("tied", "site")}, {aucs("tied", "site")}
            SELECT site, idx, {rounds(["threshold", "recall", "accuracy", "specificity", "precision", "npv", "f1", "auc"])} FROM sweep JOIN auc USING (site)""",
        "best_threshold": f"""WITH {tied("('test')")}, {sweep("tied", "site")}, {BEST},
            {best("site", "precision", "recall", "0.3::DOUBLE", "best2")}, {best("site", "f1", "f1", "0.4::DOUBLE", "best3")}
            SELECT site, {rounds(["threshold", "recall", "precision", "specificity", "accuracy", "npv", "f1"])}, found, metric
            FROM (SELECT *, 'recall' AS metric FROM best UNION ALL SELECT *, 'precision' FROM best2 UNION ALL SELECT *, 'f1' FROM best3)""",
        "mean_threshold": f"WITH {tied(chr(40) + chr(39) + 'test' + chr(39) + chr(41))}, {sweep('tied', 'site')}, {BEST} SELECT {r('avg(threshold)', 'threshold')} FROM best",
        "message_json": f"""WITH {ENC}, c AS (SELECT site, count(*) AS n, sum(icu)::BIGINT AS k, min(encounter_id) AS f FROM enc GROUP BY site)
            SELECT site, '{{"n":' || n || ',"n_icu":' || k || ',"ids":{{"first":' || f || '}}}}' AS message, n, f AS first_id FROM c""",
        "parse_ci": """SELECT o_orderkey AS encounter_id,
              CASE WHEN o_orderkey % 17 <> 0 THEN ('0.' || (o_orderkey % 97 + 1)::VARCHAR)::DOUBLE END AS point,
              CASE WHEN o_orderkey % 17 <> 0 THEN ('0.' || left(o_orderpriority, 1))::DOUBLE END AS low,
              CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 89)::DOUBLE END AS high FROM orders""",
        "init_params": f"""WITH {ENC} SELECT 'LR' AS model, site, 0 AS round, 0::BIGINT AS n_train, i::INTEGER AS idx, 0::DOUBLE AS value
            FROM (SELECT DISTINCT site FROM enc), range({len(F8) + 1}) t(i)""",
        "fedavg_params": f"WITH {MEANS} "
        + " UNION ALL ".join(
            f"SELECT 'LR' AS model, 1 AS round, {i} AS idx, {r(f'sum({f} * n_train) / sum(n_train)', 'value')} FROM means" for i, f in enumerate(F8)
        ),
        "fedavg_loss": f"""WITH {scored("('validation')")} SELECT 'LR' AS model, 1 AS round,
            {r("avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END))", "logloss")}, count(*) AS n FROM scored""",
        "lr_gradient": gradient(),
        "mlp_gradient": network_gradient(),
        "quality_ledger": LEDGER,
        "harmonise_extracts": HARMONISED,
        "lr_curvature": hessian(),
        "lr_newton_step": newton_step(),
        "shapley_exact": coalitions(),
        "feature_importance": f"WITH {MEANS}, w AS ("
        + " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(sum({f} * n_train) / sum(n_train)) AS importance FROM means" for f in F8)
        + f") SELECT feature, {r('importance', 'importance')} FROM w ORDER BY w.importance DESC, feature LIMIT 40",
        "shapley_linear": f"WITH {ATTRIBUTIONS} SELECT encounter_id, site, feature, {r('phi', 'phi')} FROM phis",
        "shap_summary": f"""WITH {ATTRIBUTIONS}, m AS (SELECT site, feature, avg(abs(phi)) AS v FROM phis GROUP BY site, feature)
            SELECT site, feature, {r("v", "mean_abs_phi")}, row_number() OVER (PARTITION BY site ORDER BY v DESC, feature)::INTEGER AS rank FROM m""",
        "site_screening": f"""WITH {scored("('train', 'test', 'validation', 'external', 'central')")},
            c AS (SELECT site, split, {cells()} FROM scored GROUP BY site, split)
            SELECT site, split, tp, fp, fn, tn, {rounds([*RATES, "f1"])}, {intervals(RATES)} FROM (SELECT *, {RATE_SQL} FROM c)""",
    }

    test_best = f"""tied_test AS (SELECT * FROM tied WHERE split = 'test'), {sweep("tied_test", "site")}, {BEST}"""
    sql["evaluate_model"] = f"""WITH {tied()}, {test_best}, {evaluated("site, split", "tied", "best", extra=variance())} SELECT * FROM evaluated"""
    scored_best = f"""scored_test AS (SELECT * FROM scored WHERE split = 'test'), {sweep("scored_test", "site")}, {BEST}"""
    sql["evaluate_model_unrounded"] = f"""WITH {scored()}, {scored_best}, {evaluated("site, split", "scored", "best", extra=variance())} SELECT * FROM evaluated"""
    percent = "printf('%.1f%% (%.1f - %.1f)', round({x} * 100, 1), round(round({x}_lo, 3) * 100, 1), round(round({x}_hi, 3) * 100, 1))"
    short = "regexp_replace(printf('%.3f', {x}), '(\\.\\d+?)0+$', '\\1')"
    sql["format_ci"] = f"""WITH {tied()}, {test_best}, {evaluated("site, split", "tied", "best")}
        SELECT site, split, {percent.format(x="sensitivity")} AS sensitivity_text, {percent.format(x="specificity")} AS specificity_text,
               {short.format(x="round(auc, 2)")} || ' (' || {short.format(x="auc_lo")} || ' - ' || {short.format(x="auc_hi")} || ')' AS auc_text
        FROM evaluated"""

    tags = "'LR' AS model, {n} AS round, 'global' AS variant, 0.85::DOUBLE AS target_sensitivity"
    first, now = model("LR", fixed.round_weights("LR", 1)), model("LR", fixed.LR_W)
    sql["federated_evaluate"] = f"""WITH {PREPARED},
        now_rows AS (SELECT encounter_id, site, split, label, {now} AS p, {first} AS q FROM prepared WHERE split IN ('test', 'validation')),
        now_test AS (SELECT * FROM now_rows WHERE split = 'test'),
        {sweep("now_test", "site")}, {BEST},
        {sweep("(SELECT site, label, q AS p FROM now_test)", "site").replace("grid AS", "grid_q AS").replace(", grid GROUP", ", grid_q GROUP")
            .replace("sweep_cells", "sweep_cells_q").replace("sweep_rates", "sweep_rates_q").replace("sweep_ppv", "sweep_ppv_q").replace(chr(10) + "sweep AS", chr(10) + "sweep_q AS")},
        {BEST.replace("best AS", "best_q AS").replace("FROM sweep)", "FROM sweep_q)")},
        hard AS (SELECT encounter_id, n.site, split, label, (q > b2.threshold)::INTEGER AS h1, (p > b1.threshold)::INTEGER AS h2
                 FROM now_rows n JOIN best b1 ON n.site = b1.site JOIN best_q b2 ON n.site = b2.site),
        {evaluated("site, split", "now_rows", "best")},
        {delong_pair("hard", "site, split", "h1", "h2")}
        SELECT evaluated.*, {r("p_value", "p_vs_round1")}, {tags.format(n=1)} FROM evaluated JOIN pvalues USING (site, split)"""
    for name, split in (("evaluate_external", "external"), ("central_evaluate", "central")):
        sql[name] = f"""WITH {scored(f"('{split}')")}, cut AS (SELECT 'MIDDLE EAST' AS site, 0.25::DOUBLE AS threshold),
            {evaluated("site, split", "scored", "cut")} SELECT *, {tags.format(n=1)} FROM evaluated"""

    iteration = "CASE WHEN model = 'NN' THEN round + 3 ELSE round END"
    sql["round_history"] = f"WITH {history()} SELECT *, {iteration} AS iteration FROM history"
    # the same rows, published or written round by round and read back
    sql["run_tables"], sql["score_stored"] = sql["round_history"], sql["evaluate_external"]
    sql["round_index"] = f"""WITH {history()} SELECT {SERIES}, split, (row_number() OVER (PARTITION BY site, model, variant, split ORDER BY round) - 1)::INTEGER AS round_index,
        auc FROM history"""
    sql["first_last_round"] = f"WITH {history()}, {first_last()} SELECT * FROM ends"
    sql["summary_table"] = f"WITH {history()}, {first_last()} {summary()}"
    sql["align_rounds"] = f"""WITH {history()}, g AS (SELECT site, model, round, auc FROM history WHERE variant = 'global')
        SELECT a.site, a.round, a.auc AS nn_auc, b.auc AS lr_auc FROM g a LEFT JOIN g b ON a.site = b.site AND a.round = b.round AND b.model = 'LR'
        WHERE a.model = 'NN'"""
    sites = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    cells_by_site = ", ".join(
        f"max({m}) FILTER (site = '{s}') AS {s.lower().replace(' ', '_')}_{m}" for s in sites for m in ("auc", "sensitivity", "fn")
    )
    sql["results_by_site"] = f"WITH {history()} SELECT model, (round - 1)::INTEGER AS round_index, {cells_by_site} FROM history WHERE variant = 'global' GROUP BY ALL"
    columns, joins = curve_columns()
    sql["federation_curves"] = f"""WITH {history()}, ix AS (SELECT *, (round - 1)::INTEGER AS round_index FROM history)
        SELECT spine.site, spine.round_index, {columns} FROM (SELECT site, round_index FROM ix WHERE model = 'NN' AND variant = 'global') spine {joins}"""
    sql["central_eval_table"] = f"""WITH {history()} SELECT {iteration} AS iteration, site, model, sensitivity, specificity, accuracy, auc, precision, npv, fn, fp, f1
        FROM history WHERE split = 'central'"""
    sql["roc_compare"] = f"""WITH {round_roc()} SELECT site, model, CASE round WHEN 1 THEN 'first_round' ELSE 'last_round' END AS stage, idx,
        {rounds(["threshold", "fpr", "tpr"])} FROM roc WHERE round IN (1, 3)"""
    roc_cells = ", ".join(f"{r(f'max({m}) FILTER (site = {text(s)})', f'{s.lower()}_{m}')}" for s in sites[:4] for m in ("tpr", "fpr"))
    sql["roc_by_site"] = f"WITH {round_roc()} SELECT model, idx, {roc_cells} FROM roc WHERE round = 3 GROUP BY model, idx"
    return sql
