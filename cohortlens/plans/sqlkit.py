"""SQL pieces shared by the cross-checks."""


def counts_sql(src, keys="", score="score", label="label"):
    k = f"{keys}, " if keys else ""
    return (f"SELECT {k}round(CAST({score} AS DOUBLE), 12) AS s, sum({label}) AS p, sum(1 - {label}) AS n "
            f"FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL")


def auc_sql(counts, keys="", name="auc"):
    """AUC per keys of a (keys, s, p, n) relation."""
    part = f"PARTITION BY {keys}" if keys else ""
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""
SELECT {k}CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(CAST(p AS DOUBLE) * (below + n / 2.0::DOUBLE)) / (CAST(sum(p) AS DOUBLE) * sum(n)) END AS {name},
       sum(p) AS n_pos, sum(n) AS n_neg
FROM (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ({counts}) c) w {g}"""


def ap_sql(counts, keys="", name="ap"):
    part = f"PARTITION BY {keys}" if keys else ""
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""
SELECT {k}CASE WHEN sum(p) > 0 THEN sum(CAST(p AS DOUBLE) * tp / (tp + fp)) / sum(p) END AS {name}
FROM (SELECT *, sum(p) OVER ({part} ORDER BY s DESC) AS tp, sum(n) OVER ({part} ORDER BY s DESC) AS fp FROM ({counts}) c) w {g}"""


def subj_sql(src, keys="", score="score"):
    k = f"{keys}, " if keys else ""
    return (f"SELECT {k}subject, round(avg(round(CAST({score} AS DOUBLE), 12)), 10) AS mean_score, max(round(CAST({score} AS DOUBLE), 12)) AS max_score, "
            f"max(label) AS label, min(label) <> max(label) AS mixed, count(*) AS n, sum(label) AS n_pos FROM {src} GROUP BY ALL")


def wilson_sql(k, n):
    z = "1.959963984540054::DOUBLE"
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    centre = f"({k} / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})"
    half = f"({z} / (1 + {z} * {z} / {n})) * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z} * {z} / (4 * {n} * {n}))"
    return (f"CASE WHEN {n} > 0 THEN greatest(0.0::DOUBLE, {centre} - {half}) END",
            f"CASE WHEN {n} > 0 THEN least(1.0::DOUBLE, {centre} + {half}) END")
