"""Fits, walk-forward backtest, choice and forecasts of the two-part model."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.stats import age_weight
from panelforge.operators import baselines, fits, model, sweeps
from panelforge.plans.panel import OBS_SQL, SERIES, observations, panel
from panelforge.plans.stored import stored
from panelforge.queries import evaluation


def _rows(spark, sf_dir):
    cells = stored(panel(spark, sf_dir), "panel")
    bridge = baselines.round_bridge(baselines.round_pairs(cells)).where("category is null or n_pairs >= 10")
    return stored(model.model_rows(observations(cells), bridge), "model-rows")


def _chosen(spark, sf_dir):
    rows = fits.packed(_rows(spark, sf_dir))
    return rows, model.choose(rows, evaluation.CALIBRATION)


def fit_level(spark, sf_dir):
    return model.effects(_rows(spark, sf_dir)).where("part = 'level'")


def fit_fill(spark, sf_dir):
    return model.effects(_rows(spark, sf_dir), couple=True).where("part = 'fill'")


def walk_forward_model(spark, sf_dir):
    return model.walk_forward(_rows(spark, sf_dir))


def halflife_grid(spark, sf_dir):
    return model.halflife_errors(_rows(spark, sf_dir), evaluation.CALIBRATION)[0]


def model_report(spark, sf_dir):
    """The same report as for the baseline, of the chosen model."""
    _, choice = _chosen(spark, sf_dir)
    empty = F.lit(None).cast("double")
    return evaluation.error_report(choice.preds.withColumns({"last": empty, "pm": empty}))


def model_choice(spark, sf_dir):
    """One row: the half-life, the log-losses with and without coupling, the recalibration, as the report's JSON."""
    _, choice = _chosen(spark, sf_dir)
    meta = F.struct(
        F.lit(choice.halflife).cast("double").alias("halflife"), F.lit(choice.couple).alias("coupled"),
        F.struct(F.lit(choice.losses[0]).alias("independent"), F.lit(choice.losses[1]).alias("coupled")).alias("fill_logloss"),
        F.struct(F.lit(choice.a).alias("a"), F.lit(choice.b).alias("b")).alias("fill_calibration"),
    )
    return spark.range(1).select(F.to_json(meta).alias("meta"))


def forecasts(spark, sf_dir):
    rows, choice = _chosen(spark, sf_dir)
    return model.forecasts(rows, choice, evaluation.spreads(choice.preds))


def forecasts_quick(spark, sf_dir):
    """Without a backtest."""
    return model.forecasts(_rows(spark, sf_dir), model.QUICK)


def _weighted(spark, sf_dir):
    """The observations, their weight halving every 4 years before the newest of all."""
    # stored before the newest year is asked for, which would make the panel twice
    obs = stored(observations(panel(spark, sf_dir)).select(*SERIES, "category", "year", "state", "v"), "observed")
    return obs.withColumn("w", age_weight(obs.agg(F.max("year")).scalar(), F.col("year"), F.lit(4.0)))


def swept_coefficients(spark, sf_dir):
    """Coefficients of two sweeps, with the information that a level of the threshold part rests on."""
    found = sweeps.coefficients(_weighted(spark, sf_dir))
    return found.select("effect", "county", "level", "year", *[F.round(c, 6).alias(c) for c in ("m", "eta", "info")])


def swept_predictions(spark, sf_dir):
    """Each series' next year and its last one, from the coefficients by joins."""
    obs = _weighted(spark, sf_dir)
    asked = obs.groupBy(*SERIES, "category").agg(F.max("year").alias("last")).withColumn("year", F.explode(F.array("last", F.col("last") + 1))).drop("last")
    return sweeps.predicted(asked, sweeps.coefficients(obs)).select(*SERIES, "category", "year", F.round("m", 6).alias("m"), F.round("pi", 6).alias("pi"))


def school_effects(spark, sf_dir):
    """Each school's effect with its standard error, 1 / sqrt(information + 1 / tau^2) for a tau of 4."""
    found = sweeps.coefficients(_weighted(spark, sf_dir)).where("effect = 'school' and m is not null")
    se = 1.0 / F.sqrt(F.col("info") + F.lit(1.0 / 16.0))
    return found.select("county", F.col("level").alias("school"), F.round("m", 6).alias("alpha"), F.round("info", 6).alias("info"), F.round(se, 6).alias("se"))


def _swept_sql(part: str, rows: str, rounds: int = 2) -> str:
    """CTEs that end in {part}_fit: ``rows`` with mu, an effect each and what is left of z."""
    steps = [f"{part}_0 AS (SELECT *, (SELECT sum(w * z) / sum(w) FROM {rows}) AS mu, {', '.join(f'0.0::DOUBLE AS e_{n}' for n in sweeps.EFFECTS)} FROM {rows})"]
    for i in range(rounds * len(sweeps.EFFECTS)):
        name, (keys, shrink) = list(sweeps.EFFECTS.items())[i % len(sweeps.EFFECTS)]
        others = " - ".join(["z", "mu", *[f"e_{n}" for n in sweeps.EFFECTS if n != name]])
        over = f"OVER (PARTITION BY {', '.join(keys)})"
        steps.append(f"{part}_{i + 1} AS (SELECT * REPLACE (sum(w * ({others})) {over} / (sum(w) {over} + {shrink}) AS e_{name}) FROM {part}_{i})")
    left = " - ".join(["z", "mu", *[f"e_{n}" for n in sweeps.EFFECTS]])
    return ",\n".join([*steps, f"{part}_fit AS (SELECT *, {left} AS rest FROM {part}_{len(steps) - 1})"])


def _levels_sql(part: str, value: str) -> str:
    rows = [f"SELECT 'mu' AS effect, NULL AS county, NULL AS level, NULL::INTEGER AS year, min(mu) AS {value}, NULL::DOUBLE AS n FROM {part}_fit"]
    for name, (keys, _) in sweeps.EFFECTS.items():
        level = {"school": "school", "cat": "category", "prog": "program", "series": "school || '|' || program", "cy": "NULL"}[name]
        county, year = ("county" if "county" in keys else "NULL"), ("year" if "year" in keys else "NULL")
        rows.append(f"SELECT '{name}', {county}, {level}, {year}, min(e_{name}), sum(w) FROM {part}_fit GROUP BY {', '.join(keys)}")
    return " UNION ALL ".join(rows)


COEFS_SQL = f"""WITH {OBS_SQL},
weighted AS (SELECT county, school, program, category, year, state, v, power(0.5, ((SELECT max(year) FROM obs) - year) / 4.0) AS w FROM obs),
numbers AS (SELECT *, CAST(v AS DOUBLE) AS z FROM weighted WHERE state = 'num'),
rate AS (SELECT sum(w * CASE WHEN state <> 'open' THEN 1 ELSE 0 END) / sum(w) AS p FROM weighted),
steps AS (SELECT weighted.* REPLACE (w * p * (1 - p) AS w), ln(p / (1 - p)) + (CASE WHEN state <> 'open' THEN 1 ELSE 0 END - p) / (p * (1 - p)) AS z FROM weighted, rate),
{_swept_sql("a", "numbers")},
{_swept_sql("b", "steps")},
a_levels AS ({_levels_sql("a", "m")}), b_levels AS ({_levels_sql("b", "eta")}),
coefs AS (SELECT b.effect, b.county, b.level, b.year, a.m, b.eta, a.n / (SELECT sum(w * rest * rest) / sum(w) FROM a_fit) AS info
  FROM b_levels b LEFT JOIN a_levels a ON a.effect = b.effect AND a.county IS NOT DISTINCT FROM b.county
    AND a.level IS NOT DISTINCT FROM b.level AND a.year IS NOT DISTINCT FROM b.year)"""


QUERIES = {
    "swept_coefficients": (swept_coefficients, f"""{COEFS_SQL}
      SELECT effect, county, level, year, round(m, 6) AS m, round(eta, 6) AS eta, round(info, 6) AS info FROM coefs"""),
    "swept_predictions": (swept_predictions, f"""{COEFS_SQL},
      last AS (SELECT county, school, program, category, max(year) AS y FROM weighted GROUP BY ALL),
      asked AS (SELECT county, school, program, category, CAST(y + k AS INTEGER) AS year FROM last, (VALUES (0), (1)) t(k)),
      cy AS (SELECT q.county, q.year, arg_max(c.m, c.year) FILTER (c.m IS NOT NULL) AS m, arg_max(c.eta, c.year) AS eta
        FROM (SELECT DISTINCT county, year FROM asked) q LEFT JOIN coefs c ON c.effect = 'cy' AND c.county = q.county AND c.year <= q.year GROUP BY 1, 2),
      mu AS (SELECT m, eta FROM coefs WHERE effect = 'mu'),
      t AS (SELECT q.*, mu.m + coalesce(k.m, 0) + coalesce(s.m, 0) + coalesce(p.m, 0) + coalesce(r.m, 0) + coalesce(cy.m, 0) AS m,
          mu.eta + coalesce(k.eta, 0) + coalesce(s.eta, 0) + coalesce(p.eta, 0) + coalesce(r.eta, 0) + coalesce(cy.eta, 0) AS eta
        FROM asked q CROSS JOIN mu LEFT JOIN coefs k ON k.effect = 'cat' AND k.level = q.category
          LEFT JOIN coefs s ON s.effect = 'school' AND s.county = q.county AND s.level = q.school
          LEFT JOIN coefs p ON p.effect = 'prog' AND p.level = q.program
          LEFT JOIN coefs r ON r.effect = 'series' AND r.county = q.county AND r.level = q.school || '|' || q.program
          LEFT JOIN cy ON cy.county = q.county AND cy.year = q.year)
      SELECT county, school, program, category, year, round(m, 6) AS m, round(1 / (1 + exp(-eta)), 6) AS pi FROM t"""),
    "school_effects": (school_effects, f"""{COEFS_SQL}
      SELECT county, level AS school, round(m, 6) AS alpha, round(info, 6) AS info, round(1 / sqrt(info + 1.0 / 16), 6) AS se
      FROM coefs WHERE effect = 'school' AND m IS NOT NULL"""),
    "fit_level": (fit_level, None),
    "fit_fill": (fit_fill, None),
    "walk_forward_model": (walk_forward_model, None),
    "halflife_grid": (halflife_grid, None),
    "model_report": (model_report, None),
    "model_choice": (model_choice, None),
    "forecasts": (forecasts, None),
    "forecasts_quick": (forecasts_quick, None),
}
