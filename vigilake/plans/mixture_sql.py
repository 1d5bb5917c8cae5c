"""The mixture of Gaussians as SQL: one recursion step a frame, over grey 8 by 8 frames, in 32-bit floats."""

from __future__ import annotations

from vigilake.pixels.models import DAY_THRESHOLD, Mixture

_K = range(1, Mixture.MODES + 1)


def _real(x: str | float) -> str:
    return f"CAST({x} AS REAL)"


def _each(form: str, joiner: str = ", ") -> str:
    return joiner.join(form.replace("#", str(k)) for k in _K)


def _sum(name: str) -> str:
    """In order, rounding after each step."""
    total = f"{name}1"
    for k in list(_K)[1:]:
        total = f"({total} + {name}{k})"
    return total


def mixture_ctes(frames: str, history: int, threshold: float = DAY_THRESHOLD) -> str:
    """CTEs up to ``mix_raw`` (scene, t, p, on_), of grey pixels ``frames`` (scene, t, p, v); for WITH RECURSIVE.

    Modes are columns w, v and m with a number, in order of weight; a mode without weight is unused.
    """
    one, zero, tiny = _real(1), _real(0), _real("1e-6")
    far = _each("(x - m#) * (x - m#) AS d#")
    cumulative = ", ".join(f"{'w1' if k == 1 else f'(c{k - 1} + w{k})'} AS c{k}" for k in _K)
    common = f"(w# > 0 AND c# - w# < {_real(Mixture.RATIO)})"
    darker = f"""({common} AND s# > 0 AND o# <= s# AND o# >= {_real(0.5)} * s# AND
        (o# / s# * m# - x) * (o# / s# * m# - x) + (o# / s# * m# - x) * (o# / s# * m# - x) + (o# / s# * m# - x) * (o# / s# * m# - x)
        < {_real(threshold)} * v# * (o# / s#) * (o# / s#))"""
    fit = "CASE " + _each(f"WHEN w# > 0 AND far# < {_real(Mixture.FIT)} * v# THEN #", " ") + " ELSE 0 END"
    decayed = _each(f"CASE WHEN w# > 0 THEN w# * ({one} - r) - r * {_real(Mixture.COMPLEXITY)} ELSE {zero} END + CASE WHEN fit = # THEN r ELSE {zero} END AS a#")
    pruned = _each(f"CASE WHEN a# >= r * {_real(Mixture.COMPLEXITY)} THEN a# ELSE {zero} END AS b#")
    lowest = f"CASE WHEN fit > 0 THEN 0 ELSE list_position([{_each('b#')}], least({_each('b#')})) END"
    emptied = _each(f"CASE WHEN slot = # THEN {zero} ELSE b# END AS e#")
    placed = _each(
        f"CASE WHEN fit > 0 THEN e# WHEN slot = # THEN CASE WHEN left_ > 0 THEN r ELSE {one} END WHEN left_ > 0 THEN e# * (({one} - r) / greatest(left_, {tiny})) ELSE {zero} END AS g#"
    )
    pace = "CASE fit " + _each(f"WHEN # THEN r / greatest(b#, {tiny})", " ") + f" ELSE {zero} END"
    moved = _each(f"CASE WHEN slot = # THEN x WHEN fit = # THEN m# + pace * (x - m#) ELSE m# END AS n#")  # noqa: F541
    spread = _each(
        f"CASE WHEN slot = # THEN {_real(Mixture.START_VAR)} WHEN fit = # THEN greatest({_real(Mixture.LEAST_VAR)}, least({_real(Mixture.MOST_VAR)}, v# + pace * (far# - v#))) ELSE v# END AS q#"
    )
    packed = _each("{'k': -(g# / total), 'i': #, 'v': q#, 'm': n#}")
    opened = ", ".join(f"-(s[{k}].k) AS w{k}, s[{k}].v AS v{k}, s[{k}].m AS m{k}" for k in _K)
    names = ", ".join(f"w{k}, v{k}, m{k}" for k in _K)
    empty = ", ".join(f"{zero} AS w{k}, {_real(Mixture.START_VAR)} AS v{k}, {zero} AS m{k}" for k in _K)
    return f"""mix(scene, p, t, on_, {names}) AS (
  SELECT DISTINCT scene, p, CAST(-1 AS BIGINT), FALSE, {empty} FROM {frames}
  UNION ALL
  SELECT scene, p, t, on_, {opened} FROM (
  SELECT scene, p, t, on_, list_sort([{packed}]) AS s FROM (
  SELECT *, greatest({_sum("g")}, {tiny}) AS total FROM (
  SELECT *, {placed}, {moved}, {spread} FROM (
  SELECT *, {_sum("e")} AS left_, {pace} AS pace FROM (
  SELECT *, {emptied} FROM (
  SELECT *, {lowest} AS slot FROM (
  SELECT *, {pruned} FROM (
  SELECT *, {decayed} FROM (
  SELECT *, NOT ({_each(f"({common} AND far# < {_real(threshold)} * v#)", " OR ")}) AND NOT ({_each(darker, " OR ")}) AS on_, {fit} AS fit FROM (
  SELECT *, {cumulative}, {_each("(d# + d#) + d# AS far#")}, {_each("(x * m# + x * m#) + x * m# AS o#")}, {_each("(m# * m# + m# * m#) + m# * m# AS s#")} FROM (
  SELECT f.scene, f.p, f.t, CAST(f.v AS REAL) AS x, CAST(1.0::DOUBLE / least(2 * (f.t + 1), {history}) AS REAL) AS r, {names}, {far.replace("x -", "CAST(f.v AS REAL) -")}
  FROM mix JOIN {frames} f ON f.scene = mix.scene AND f.p = mix.p AND f.t = mix.t + 1)))))))))))),
mix_raw AS (SELECT scene, t, p, on_ FROM mix WHERE t >= 0)"""
