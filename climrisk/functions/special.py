"""Special functions as SQL expressions: they run inside the plan, without Python workers.

Arguments are SQL texts, such as column names, and so are the results: `F.expr(normal_quantile("p"))`.
A value that is used more than once is bound to a lambda variable, so texts and plans stay small.
Each function has a number of steps that bounds its error; where that isn't enough the result is NULL.
"""

from __future__ import annotations

#: From here on the asymptotic series below are good to the last digits of a double.
_FAR = 10.0
_SHIFTS = 10

#: Newton steps for the shape, and the relative step at which it counts as found.
SHAPE_STEPS = 60
SHAPE_TOLERANCE = 1e-12

#: Largest shape with a distribution function: values that spread by under 0.01 % are as good as flat.
SHAPE_LIMIT = 1e8

#: Beyond this exponent a tail has less than 5e-18 of the mass.
_TAIL = 40.0

# Bernoulli quotients of the asymptotic series in 1 / y**2, first term first.
_LOG_GAMMA = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_DIGAMMA = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12)
_TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)

# Published rational approximations of the normal quantile (AS 241), highest power first.
CENTRE = (
    (
        2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
        1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0,
    ),
    (
        5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
        5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0,
    ),
)
FLANK = (
    (
        7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
        3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0,
    ),
    (
        1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
        6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0,
    ),
)
FAR_TAIL = (
    (
        2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
        2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0,
    ),
    (
        2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
        1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
    ),
)


def _let(body: str, name: str, **values: str) -> str:
    """`body` with the fields of the struct `name` at hand, each computed once."""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"transform(array(named_struct({fields})), {name} -> {body})[0]"


def polynomial(coefficients, x: str) -> str:
    """Value at `x`, highest power first."""
    first, *rest = (f"{c!r}D" for c in coefficients)
    text = first
    for c in rest:
        text = f"({text} * {x} + {c})"
    return text


def _series(coefficients, r: str) -> str:
    return polynomial(tuple(reversed(coefficients)), r)


def _shifted(body: str, name: str, x: str) -> str:
    """`body` with x, y = x moved to where the series are good, and r = 1 / y**2."""
    moved = _let(
        f"named_struct('x', {name}.x, 'y', {name}.y, 'r', 1 / ({name}.y * {name}.y))",
        name,
        x=f"{name}.x",
        y=f"if({name}.x < {_FAR}D, {name}.x + {_SHIFTS}, {name}.x)",
    )
    bound = _let(moved, name, x=f"double({x})")
    return f"transform(array({bound}), {name} -> {body})[0]"


def _steps(name: str, term: str, between: str) -> str:
    """Terms of x, x + 1, ... up to y, joined; `{v}` stands for one of them."""
    return between.join(term.format(v=f"({name}.x + {k})") for k in range(_SHIFTS))


def log_gamma(x: str) -> str:
    """Logarithm of the gamma function for x > 0."""
    far = f"(g.y - 0.5D) * ln(g.y) - g.y + 0.9189385332046727D + {_series(_LOG_GAMMA, 'g.r')} / g.y"
    return _shifted(f"({far}) - if(g.x < {_FAR}D, ln({_steps('g', '{v}', ' * ')}), 0D)", "g", x)


def log_less_digamma(x: str) -> str:
    """ln x - digamma(x), without the difference of near numbers where x is large."""
    near = f"{_steps('d', '1 / {v}', ' + ')} - ln(d.y / d.x)"
    return _shifted(f"0.5D / d.y + {_series(_DIGAMMA, 'd.r')} * d.r + if(d.x < {_FAR}D, {near}, 0D)", "d", x)


def trigamma_less_inverse(x: str) -> str:
    """trigamma(x) - 1 / x for x > 0."""
    near = f"{_steps('t', '1 / ({v} * {v})', ' + ')} + 1 / t.y - 1 / t.x"
    return _shifted(f"0.5D * t.r + {_series(_TRIGAMMA, 't.r')} * t.r / t.y + if(t.x < {_FAR}D, {near}, 0D)", "t", x)


def gamma_shape(mean: str, mean_log: str) -> str:
    """Maximum-likelihood shape with the origin at zero: solves ln a - digamma(a) = ln mean - mean_log.

    NULL where that difference isn't positive, or Newton's steps have not come to rest.
    """
    start = "named_struct('a', (3 - n.s + sqrt((n.s - 3) * (n.s - 3) + 24 * n.s)) / (12 * n.s), 'found', false)"
    step = f"m.a + ({log_less_digamma('m.a')} - n.s) / {trigamma_less_inverse('m.a')}"
    taken = _let(
        f"named_struct('a', k.a, 'found', abs(k.a - m.a) <= {SHAPE_TOLERANCE!r}D * m.a)",
        "k",
        a=_let("if(j.a > 0, j.a, m.a / 2)", "j", a=step),
    )
    newton = f"aggregate(sequence(1, {SHAPE_STEPS}), {start}, (m, i) -> if(m.found, m, {taken}), m -> if(m.found, m.a, NULL))"
    return _let(f"if(n.s > 0 and not isnan(n.s), {newton}, NULL)", "n", s=f"ln({mean}) - ({mean_log})")


def gamma_cdf(x: str, shape: str) -> str:
    """Regularised lower incomplete gamma P(shape, x) for x > 0; error below 1e-12.

    The power series has positive terms only. Their number is fixed beforehand, so that what is left
    out is less than 1e-17 of the sum; where a tail holds less than that the result is 0 or 1. A shape
    over SHAPE_LIMIT has no result.
    """
    # x**a * exp(-x) / gamma(a + 1); e is the exponent of either tail and of the density itself.
    far = f"exp(-e.e - {_series(_LOG_GAMMA, '(1 / (e.a * e.a))')} / e.a) / sqrt(6.283185307179586D * e.a)"
    near = f"exp(e.a * ln(e.x) - e.x - {log_gamma('e.a + 1')})"
    count = "int(ceil(greatest(e.x - e.a, 0D) + 50 + 10 * sqrt(greatest(e.x, e.a) + 50)))"
    following = _let("named_struct('term', h.term, 'sum', p.sum + h.term)", "h", term="p.term * e.x / (e.a + n)")
    total = (
        f"aggregate(sequence(1, {count}), named_struct('term', 1D, 'sum', 1D), (p, n) -> {following}, p -> p.sum)"
    )
    inside = f"least(if(e.a >= {_FAR}D, {far}, {near}) * {total}, 1D)"
    body = f"if(e.e > {_TAIL}D, if(e.x > e.a, 1D, 0D), {inside})"
    exponent = _let("c.a * (c.off - log1p(c.off))", "c", a="b.a", off="(b.x - b.a) / b.a")
    known = f"b.a > 0 and b.a <= {SHAPE_LIMIT!r}D and b.x > 0 and not isnan(b.x)"
    return _let(
        f"if({known}, {_let(body, 'e', x='b.x', a='b.a', e=exponent)}, NULL)",
        "b",
        x=f"double({x})",
        a=f"double({shape})",
    )


def normal_quantile(p: str) -> str:
    """Quantile of the standard normal for 0 < p < 1, to 16 digits."""
    ratio = lambda pair, at: f"{polynomial(pair[0], at)} / {polynomial(pair[1], at)}"
    centre = _let(f"u.q * {ratio(CENTRE, 'u.c')}", "u", q="q.d", c="0.180625D - q.d * q.d")
    flank = _let(
        f"if(w.r <= 5, {ratio(FLANK, '(w.r - 1.6D)')}, {ratio(FAR_TAIL, '(w.r - 5)')})",
        "w",
        r="sqrt(-ln(least(q.p, 1 - q.p)))",
    )
    body = f"case when abs(q.d) <= 0.425D then {centre} when q.p > 0 and q.p < 1 then sign(q.d) * {flank} end"
    return _let(body, "q", p=f"double({p})", d=f"double({p}) - 0.5D")


# Probability limits before the normal quantile (about +-3.719).
LOWEST, HIGHEST = 1e-4, 1 - 1e-4


def standard_index(total: str, shape: str, scale: str, zero_share: str) -> str:
    """Mixed distribution to the standard normal; a zero total sits at half the zero mass."""
    wet = f"s.z + (1 - s.z) * {gamma_cdf('s.x / s.b', 's.a')}"
    chance = f"case when s.a is null or s.b is null or isnan(s.x) then null when s.x > 0 then {wet} when s.x <= 0 then s.z / 2 end"
    # least() and greatest() pass over a NULL, so it is kept out of them.
    limited = f"if(v.p is null, null, least(greatest(v.p, {LOWEST!r}D), {HIGHEST!r}D))"
    index = normal_quantile(_let(limited, "v", p="s.p"))
    return _let(
        _let(index, "s", p=chance),
        "s",
        x=f"double({total})",
        a=shape,
        b=scale,
        z=zero_share,
    )
