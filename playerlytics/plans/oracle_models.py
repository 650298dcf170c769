"""SQL of the segmentation models: the iterations of ``operators.game_models`` unrolled into CTEs.

Written over plain columns (x0..x4 of a vector, c0..c4 of a centre, f0..f4 scale factors) instead
of arrays; each iteration is a CTE that reads the one before it. ``seg`` is the input.
"""

from __future__ import annotations

from collections.abc import Sequence

FEATURES = ("numLevelsCompleted", "numAdsWatched", "numPurchasesDone", "partOfDayNumber", "flagOrganic")
_I = range(len(FEATURES))
_X, _C, _F = (", ".join(f"{v}{i}" for i in _I) for v in "xcf")
#: Rotations of a sweep: the pairs of rows, in order.
_PAIRS = [(p, q) for p in _I for q in _I if p < q]
_SWEEPS = 8


def _distance(x: str, c: str) -> str:
    """Scaled squared distance; ``x`` and ``c`` are patterns with the place of the feature's number, x's row has the factors."""
    return " + ".join(f"(({x} - {c}) * f# * (({x} - {c}) * f#))".replace("#", str(i)) for i in _I)


def vectors() -> str:
    """gv: weighted distinct vectors; gm: moments and factors of each game; pts: both."""
    variances = [f"(p{i} - s{i} * s{i} / n) / (n - 1)" for i in _I]
    factors = ", ".join(f"CASE WHEN n > 1 AND {v} > 0 THEN 1 / sqrt({v}) ELSE 0.0 END AS f{i}" for i, v in enumerate(variances))
    return f"""
gv AS MATERIALIZED (
  SELECT gameId, {', '.join(f'CAST({c} AS DOUBLE) AS x{i}' for i, c in enumerate(FEATURES))}, CAST(count(*) AS DOUBLE) AS w
  FROM seg WHERE gameId IS NOT NULL GROUP BY ALL),
gs AS MATERIALIZED (
  SELECT gameId, sum(w) AS n, {', '.join(f'sum(w * x{i}) AS s{i}' for i in _I)}, {', '.join(f'sum(w * x{i} * x{i}) AS p{i}' for i in _I)}
  FROM gv GROUP BY gameId),
gm AS MATERIALIZED (SELECT gameId, n, {', '.join(f's{i}' for i in _I)}, {factors} FROM gs),
pts AS MATERIALIZED (SELECT gv.*, {_F} FROM gv JOIN gm USING (gameId))"""


def starts(k: int) -> str:
    """start1..: the heaviest vector of each game, then each time the one farthest from those chosen; starts: all of them."""
    order = ", ".join(f"x{i}" for i in _I)
    found = [f"""
start0 AS MATERIALIZED (
  SELECT gameId, {', '.join(f'x{i} AS c{i}' for i in _I)} FROM (
    SELECT *, row_number() OVER (PARTITION BY gameId ORDER BY w DESC, {order}) AS b FROM pts) t WHERE b = 1),
near0 AS MATERIALIZED (SELECT pts.*, {_distance('pts.x#', 'c#')} AS near FROM pts JOIN start0 USING (gameId))"""]
    for j in range(1, k):
        found.append(f"""
start{j} AS MATERIALIZED (
  SELECT gameId, {', '.join(f'x{i} AS c{i}' for i in _I)} FROM (
    SELECT *, row_number() OVER (PARTITION BY gameId ORDER BY near DESC, {order}) AS b FROM near{j - 1} WHERE near > 0) t WHERE b = 1),
near{j} AS MATERIALIZED (
  SELECT n.gameId, {', '.join(f'n.x{i}' for i in _I)}, n.w, {', '.join(f'n.f{i}' for i in _I)},
         CASE WHEN c0 IS NULL THEN near ELSE least(near, {_distance('n.x#', 'c#').replace('* f', '* n.f')}) END AS near
  FROM near{j - 1} n LEFT JOIN start{j} c ON c.gameId = n.gameId)""")
    union = " UNION ALL ".join(f"SELECT gameId, {j} AS id, {_C} FROM start{j}" for j in range(k))
    return ",".join(found) + f",\nstarts AS MATERIALIZED ({union})"


def lloyd(ks: Sequence[int], max_iter: int, tolerance: float) -> str:
    """models0.. and models: centres of every game and k after each iteration, with whether they have come to rest."""
    sets = " UNION ALL ".join(f"SELECT {k} AS k" for k in ks)
    found = [f"\nmodels0 AS MATERIALIZED (SELECT gameId, k, id, {_C}, FALSE AS done FROM starts JOIN ({sets}) ks ON id < k)"]
    for t in range(1, max_iter + 1):
        old = f"models{t - 1}"
        moved = _distance("c#", "o#").replace("* f", "* gm.f")
        found.append(f"""
near_{t} AS (
  SELECT p.gameId, m.k, m.id, {', '.join(f'p.x{i}' for i in _I)}, p.w,
         row_number() OVER (PARTITION BY p.gameId, m.k, {', '.join(f'p.x{i}' for i in _I)}
                            ORDER BY {_distance('p.x#', 'm.c#').replace('* f', '* p.f')}, m.id) AS b
  FROM pts p JOIN {old} m ON m.gameId = p.gameId AND NOT m.done),
mean_{t} AS (
  SELECT gameId, k, id, {', '.join(f'sum(w * x{i}) / sum(w) AS c{i}' for i in _I)} FROM near_{t} WHERE b = 1 GROUP BY gameId, k, id),
step_{t} AS MATERIALIZED (
  SELECT m.gameId, m.k, m.id, m.done, {', '.join(f'coalesce(n.c{i}, m.c{i}) AS c{i}' for i in _I)}, {', '.join(f'm.c{i} AS o{i}' for i in _I)}
  FROM {old} m LEFT JOIN mean_{t} n ON n.gameId = m.gameId AND n.k = m.k AND n.id = m.id),
models{t} AS MATERIALIZED (
  SELECT s.gameId, s.k, s.id, {', '.join(f's.c{i}' for i in _I)}, s.done OR r.far <= {tolerance ** 2!r} AS done
  FROM step_{t} s JOIN (SELECT gameId, k, max({moved}) AS far FROM step_{t} JOIN gm USING (gameId) GROUP BY gameId, k) r
    ON r.gameId = s.gameId AND r.k = s.k)""")
    return ",".join(found) + f",\nmodels AS (SELECT * FROM models{max_iter})"


def fitted(ks: Sequence[int], max_iter: int, tolerance: float) -> str:
    """All CTEs of a fit."""
    return ",".join([vectors(), starts(max(ks)), lloyd(ks, max_iter, tolerance)])


def nearest() -> str:
    """near_end: every vector with its nearest centre under each k."""
    return f"""
near_end AS MATERIALIZED (
  SELECT * FROM (
    SELECT p.gameId, m.k, m.id, {', '.join(f'p.x{i}' for i in _I)}, p.w, {_distance('p.x#', 'm.c#').replace('* f', '* p.f')} AS d,
           row_number() OVER (PARTITION BY p.gameId, m.k, {', '.join(f'p.x{i}' for i in _I)}
                              ORDER BY {_distance('p.x#', 'm.c#').replace('* f', '* p.f')}, m.id) AS b
    FROM pts p JOIN models m ON m.gameId = p.gameId) t WHERE b = 1)"""


def labels() -> str:
    """Rows of seg with their cluster (one k)."""
    same = " AND ".join(f"n.x{i} = s.{c}" for i, c in enumerate(FEATURES))
    return f"SELECT s.*, CAST(n.id AS INTEGER) AS cluster FROM seg s JOIN near_end n ON n.gameId = s.gameId AND {same}"


def principal(k: int) -> str:
    """axes: the first ``k`` principal vectors of each game (e0.. of component a), by Jacobi rotations, one a step."""
    d = len(FEATURES)
    pairs = "[" + ", ".join(f"[{p}, {q}]" for p, q in _PAIRS) + "]"
    products = ", ".join(f"sum(w * x{i} * x{j}) AS p{i}{j}" for i in _I for j in _I if i <= j)
    cells = ", ".join(f"coalesce((p{min(i, j)}{max(i, j)} - s{i} * s{j} / n) / nullif(n - 1, 0) * f{i} * f{j}, 0.0)" for i in _I for j in _I)
    unit = ", ".join("1.0" if i == j else "0.0" for i in _I for j in _I)
    unit = f"CAST([{unit}] AS DOUBLE[])"

    def turned(m: str, axis: str, other: str) -> str:
        """Mixed along ``axis`` (an expression of the cell's number n), at the same ``other``."""
        at = (lambda r: f"{m}[{r} * {d} + {other} + 1]") if axis.startswith("n //") else (lambda r: f"{m}[({other}) * {d} + {r} + 1]")
        return (f"list_transform(range({d * d}), lambda n: CASE WHEN {axis} = p THEN c * {at('p')} - s * {at('q')} "
                f"WHEN {axis} = q THEN s * {at('p')} + c * {at('q')} ELSE {m}[n + 1] END)")

    columns, rows = (f"n % {d}", f"n // {d}"), (f"n // {d}", f"n % {d}")
    vector = ", ".join(f"v[{i * d} + j + 1] AS u{i}" for i in _I)
    lead = "CASE " + " ".join(f"WHEN abs(u{i}) >= top - 1e-9 THEN u{i}" for i in _I) + " END"
    return f"""
gp AS (SELECT gameId, {products} FROM gv GROUP BY gameId),
jac AS (
  SELECT gameId, 0 AS step, CAST([{cells}] AS DOUBLE[]) AS a, {unit} AS v FROM gm JOIN gp USING (gameId)
  UNION ALL
  SELECT gameId, step + 1, {turned('b', *rows)} AS a, v FROM (
    SELECT gameId, step, p, q, c, s, {turned('a', *columns)} AS b, {turned('v', *columns)} AS v FROM (
      SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM (
        SELECT *, CASE WHEN o = 0 THEN 0.0 ELSE (CASE WHEN h / o < 0 THEN -1.0 ELSE 1.0 END) / (abs(h / o) + sqrt((h / o) * (h / o) + 1)) END AS t FROM (
          SELECT *, a[p * {d} + q + 1] AS o, (a[q * {d} + q + 1] - a[p * {d} + p + 1]) / 2 AS h FROM (
            SELECT gameId, step, a, v, ({pairs})[step % {len(_PAIRS)} + 1][1] AS p, ({pairs})[step % {len(_PAIRS)} + 1][2] AS q
            FROM jac WHERE step < {_SWEEPS * len(_PAIRS)}) x0) x1) x2) x3) x4),
ends AS MATERIALIZED (SELECT gameId, a, v FROM jac WHERE step = {_SWEEPS * len(_PAIRS)}),
vecs AS (
  SELECT gameId, row_number() OVER (PARTITION BY gameId ORDER BY a[j * {d} + j + 1] DESC) - 1 AS axis, {vector}
  FROM ends, (SELECT unnest(range({d})) AS j) js),
axes AS MATERIALIZED (
  SELECT gameId, axis, {', '.join(f'CASE WHEN {lead} < 0 THEN -u{i} ELSE u{i} END AS e{i}' for i in _I)}
  FROM (SELECT *, greatest({', '.join(f'abs(u{i})' for i in _I)}) AS top FROM vecs) t WHERE axis < {k})"""


def projection(axis: int) -> str:
    """A row's projection on an axis: its scaled features (columns x0.., f0..) times the vector."""
    return " + ".join(f"a{axis}.e{i} * (x{i} * f{i})" for i in _I)
