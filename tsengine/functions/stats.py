"""Regression aggregates and distribution functions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def ols(y: Column, x: Column) -> Column:
    """Least squares of y on x as one aggregate struct; rows with a missing side are skipped."""
    return F.struct(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    )


def ols_columns(fit: Column) -> dict[str, Column]:
    """Slope, intercept, r, r², standard error and rates of an ``ols`` struct.

    Fewer than two points, or a constant x, give zeros and p = 1.
    """
    usable = (fit["n"] >= 2) & (fit["sxx"] > 0)

    def guarded(c: Column) -> Column:
        return F.when(usable, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))

    r = F.try_divide(fit["sxy"], F.sqrt(fit["sxx"] * fit["syy"]))
    # least and greatest skip nulls, so an undefined r must not reach them.
    r = F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    unexplained = F.greatest(F.lit(1.0) - r * r, F.lit(0.0))
    std_err = F.sqrt(F.try_divide(unexplained * fit["syy"], fit["sxx"] * (fit["n"] - 2)))
    slope = guarded(fit["slope"])
    return {
        "n": fit["n"],
        "slope": slope,
        "intercept": guarded(fit["intercept"]),
        "r_value": guarded(r),
        "r_squared": guarded(r * r),
        "std_err": guarded(std_err),
        "trend_per_year": slope * DAYS_PER_YEAR,
        "trend_per_decade": slope * DAYS_PER_YEAR * 10,
        "degenerate": ~usable,
    }


# ln(gamma(a + 1/2) / gamma(a)) - ln(a) / 2 in odd powers of 1 / a, from the first on.
HALF_STEP = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)
HALF_STEP_SHIFT = 12


def log_half_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)), without the cancellation of two large log gammas.

    The series holds far out; nearer, the step is taken at ``a + HALF_STEP_SHIFT`` and carried back by
    gamma(z + 1) = z * gamma(z).
    """
    far = a + HALF_STEP_SHIFT
    series = F.log(far) / 2 + sum((F.lit(c) / F.pow(far, F.lit(2.0 * i + 1)) for i, c in enumerate(HALF_STEP)), F.lit(0.0))
    back = F.lit(1.0)
    for i in range(HALF_STEP_SHIFT):
        back = back * (a + i) / (a + (i + 0.5))
    return series + F.log(back)


def beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function; its steps grow with the root of the larger parameter."""
    start = F.struct(F.lit(float("inf")).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))

    def step(s: Column, j: Column) -> Column:
        k = F.floor(j / 2)
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        coefficient = F.when(j % 2 == 0, even).otherwise(odd)
        # c and d first, then h from the new ones
        new = F.struct((1.0 + coefficient / s["c"]).alias("c"), (1.0 / (1.0 + coefficient * s["d"])).alias("d"))
        return F.transform(F.array(new), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h")))[0]

    steps = F.sequence(F.lit(1), F.ceil(60 + 8 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def student_t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) of Student's t as a regularised incomplete beta function; null without degrees of freedom."""

    def given(v: Column) -> Column:
        square = v["t"] * v["t"]
        own = F.struct((v["dof"] / 2).alias("a"), (v["dof"] / (v["dof"] + square)).alias("x"), (square / (v["dof"] + square)).alias("rest"))
        endless = (v["t"] == float("inf")) | (v["t"] == float("-inf"))
        return F.when(v["t"].isNotNull() & (v["dof"] > 0), F.when(endless, 0.0).otherwise(_once(own, tail)))

    def tail(v: Column) -> Column:
        a, b, x, rest = v["a"], F.lit(0.5), v["x"], v["rest"]  # rest is 1 - x without cancellation
        front = F.exp(a * F.log(x) + b * F.log(rest) + log_half_step(a) - math.log(math.pi) / 2)
        low = x < (a + 1) / (a + b + 2)
        p = F.when(low, front * beta_fraction(a, b, x) / a).otherwise(1.0 - front * beta_fraction(b, a, rest) / b)
        return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))

    return _once(F.struct(t.alias("t"), dof.alias("dof")), given)


def trend_p_value(n: Column, slope: Column, std_err: Column, r_squared: Column) -> Column:
    """Two-sided p-value of an OLS slope; runs on aggregated rows only.

    Two points leave no residual: p is 0 for a slope and 1 for a flat pair.
    """
    dof = (n - 2).cast("double")
    t = F.try_divide(slope, std_err)
    t = F.when(t.isNull() & (slope != 0) & (r_squared > 0), F.lit(float("inf"))).otherwise(t)
    p = F.nanvl(student_t_two_sided(t, dof), F.lit(None).cast("double"))
    flat = F.when(slope == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(n < 2, F.lit(1.0)).when(n == 2, flat).otherwise(F.coalesce(p, F.lit(1.0)))


def nan_free(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal by rational approximation, AS 241 (Wichura 1988)."""

    def horner(values, x):
        out = F.lit(values[-1])
        for v in reversed(values[:-1]):
            out = out * x + F.lit(v)
        return out

    q = p - 0.5
    mid = 0.180625 - q * q
    tail = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1.0 - p)))
    near, far = tail - 1.6, tail - 5.0
    outer = F.when(
        tail <= 5.0, horner(AS241["c"], near) / horner(AS241["d"], near)
    ).otherwise(horner(AS241["e"], far) / horner(AS241["f"], far))
    return F.when(F.abs(q) <= 0.425, q * horner(AS241["a"], mid) / horner(AS241["b"], mid)).otherwise(
        F.when(q < 0, -outer).otherwise(outer)
    )


# Coefficients of AS 241, lowest power first.
AS241 = {
    "a": (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
          1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
          3.3430575583588128105e4, 2.5090809287301226727e3),
    "b": (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
          2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
          5.2264952788528545610e3),
    "c": (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
          3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
          2.27238449892691845833e-2, 7.74545014278341407640e-4),
    "d": (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
          1.05075007164441684324e-9),
    "e": (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
          2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
          2.71155556874348757815e-5, 2.01033439929228813265e-7),
    "f": (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
          2.04426310338993978564e-15),
}


def z_score(confidence: float) -> float:
    """Interval multiplier: 1.96 at 95 %, otherwise the 99 % value."""
    return 1.96 if confidence == 0.95 else 2.576


NORMAL_975 = NormalDist().inv_cdf(0.975)
