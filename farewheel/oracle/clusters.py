"""SQL of the k-means queries: the fit by recursion over its rounds, all runs side by side."""

from __future__ import annotations

from farewheel.oracle.base import TABLES, n, q, r

# Features, and the persona named by each share.
FEATURES = ("duration_min", "hour_of_day", "is_weekend", "is_ebike", "month", "is_summer", "is_peak_hr")
NAMED_BY = (("Weekend Explorer", "pct_weekend"), ("Reluctant Commuter", "pct_peak_hr"),
            ("Seasonal Visitor", "pct_summer"), ("E-bike Adopter", "pct_ebike"))
DIMS = range(len(FEATURES))


def _points() -> str:
    """Rides (ft), moments (mo), distinct points with scaled parts (pt: x0.. features, w0.. whole numbers)."""
    moments = ", ".join(
        f"{q(f'SUM({f})', 'COUNT(*)')} AS m{i}, {q(f'SUM({f} * {f})', 'COUNT(*)')} AS s{i}" for i, f in enumerate(FEATURES))
    deviations = ", ".join(f"m{i}, NULLIF(sqrt(greatest(s{i} - m{i} * m{i}, 0)), 0) AS d{i}" for i in DIMS)
    whole = ", ".join(
        f"CAST(round({f} * 60000) AS BIGINT) AS w{i}" if i == 0 else f"{f} AS w{i}" for i, f in enumerate(FEATURES))
    return f"""{TABLES},
    ft AS MATERIALIZED (SELECT ride_id, duration_min, {n('hour(started_at)')} AS hour_of_day,
        {n('isodow(started_at) > 5')} AS is_weekend, {n("bike_type = 'EFIT'")} AS is_ebike,
        {n('month(started_at)')} AS month, {n('month(started_at) BETWEEN 6 AND 8')} AS is_summer,
        {n('hour(started_at) BETWEEN 7 AND 9')} AS is_peak_hr, ride_cost_cad
      FROM rides WHERE user_type = 'Casual Member'),
    mo AS MATERIALIZED (SELECT {deviations} FROM (SELECT {moments} FROM ft)),
    pt AS MATERIALIZED (SELECT *, {', '.join(f'CAST({f} AS DOUBLE) AS x{i}' for i, f in enumerate(FEATURES))} FROM (
      SELECT {', '.join(FEATURES)}, {whole}, COUNT(*) AS n, CAST(SUM(round(ride_cost_cad * 100)) AS BIGINT) AS cents,
        COUNT(ride_cost_cad) AS priced FROM ft GROUP BY ALL) CROSS JOIN mo)"""


def _apart(at: list[str], to: list[str]) -> str:
    return "(" + " + ".join(
        f"COALESCE(({a} - {b}) / d{i} * (({a} - {b}) / d{i}), 0)" for i, (a, b) in enumerate(zip(at, to))) + ")"


def _centre(c: int) -> list[str]:
    return [f"c{c}_{i}" for i in DIMS]


POINT = [f"x{i}" for i in DIMS]


def _first_of(distances: list[str]) -> str:
    return f"CASE least({', '.join(distances)}) " + " ".join(f"WHEN {d} THEN {c}" for c, d in enumerate(distances)) + " END"


def _fit(k: int, runs: int, slots: int) -> str:
    """f{k}: the run of least cost with its centres; a{k}: every point with its cluster and distance."""
    columns = [name for c in range(k) for name in _centre(c)]
    draws = ", ".join(
        f"arg_min(struct_pack({', '.join(f'w{i} := w{i}' for i in DIMS)}), md5(concat_ws('|', 42, run, {c}, "
        f"{', '.join(f'w{i}' for i in DIMS)}))) AS p{c}" for c in range(k))
    begun = ", ".join(
        f"CAST(p{c}.w{i} AS DOUBLE) / {60000 if i == 0 else 1} AS c{c}_{i}" for c in range(k) for i in DIMS)
    distances = ", ".join(f"{_apart(POINT, _centre(c))} AS e{c}" for c in range(k))
    own = _first_of([f"e{c}" for c in range(k)])
    olds = ", ".join(f"ANY_VALUE({x}) AS o{x}" for x in columns)
    news = ", ".join(
        f"COALESCE({q(f'SUM(w{i} * n) FILTER (own = {c})', f'SUM(n) FILTER (own = {c})')} / {60000 if i == 0 else 1}, "
        f"ANY_VALUE(c{c}_{i})) AS {x}" for c in range(k) for i, x in enumerate(_centre(c)))
    moved = ", ".join(_apart(_centre(c), [f"o{x}" for x in _centre(c)]) for c in range(k))
    return f"""
    l{k} AS (
      SELECT run, 0 AS step, TRUE AS live, {begun} FROM (SELECT run, {draws} FROM pt, range({runs}) t(run) GROUP BY run)
      UNION ALL
      SELECT run, step + 1, greatest({moved}) > 1e-4 * 1e-4, {', '.join(columns)} FROM (
        SELECT run, ANY_VALUE(step) AS step, {', '.join(f'ANY_VALUE(d{i}) AS d{i}' for i in DIMS)}, {olds}, {news} FROM (
          SELECT *, {own} AS own FROM (SELECT l{k}.*, pt.*, {distances} FROM l{k}, pt WHERE live AND step < 300))
        GROUP BY run)),
    f{k} AS MATERIALIZED (
      SELECT {', '.join(columns)} FROM (
        SELECT run, SUM(CAST(floor(n * least({', '.join(_apart(POINT, _centre(c)) for c in range(k))}) * 1e6 + 0.5) AS BIGINT)) AS cost
        FROM (SELECT * FROM l{k} QUALIFY step = MAX(step) OVER (PARTITION BY run)), pt GROUP BY run)
      JOIN (SELECT * FROM l{k} QUALIFY step = MAX(step) OVER (PARTITION BY run)) USING (run)
      ORDER BY cost, run LIMIT 1),
    a{k} AS MATERIALIZED (
      SELECT *, CAST({own} AS BIGINT) AS cluster, least({', '.join(f'e{c}' for c in range(k))}) AS off
      FROM (SELECT pt.*, {', '.join(columns)}, {distances} FROM pt, f{k}))"""


def _silhouette(k: int) -> str:
    """v{k}: inertia and silhouette of one k."""
    middle = ", ".join(
        f"{q(f'SUM(w{i} * n) FILTER (cluster = {c})', f'SUM(n) FILTER (cluster = {c})')} / {60000 if i == 0 else 1} AS u{c}_{i}"
        for c in range(k) for i in DIMS)
    sizes = ", ".join(f"CAST(SUM(n) FILTER (cluster = {c}) AS DOUBLE) AS n{c}" for c in range(k))
    to = {c: _apart(POINT, [f"u{c}_{i}" for i in DIMS]) for c in range(k)}
    around = ", ".join(
        f"SUM(CAST(floor(n * {to[c]} * 1e6 + 0.5) AS BIGINT)) FILTER (cluster = {c})::DOUBLE / 1e6 / ANY_VALUE(n{c}) AS v{c}" for c in range(k))
    from_each = ", ".join(f"CASE WHEN n{c} > 0 THEN {to[c]} + v{c} END AS g{c}" for c in range(k))
    inside = "CASE cluster " + " ".join(f"WHEN {c} THEN g{c} * n{c} / NULLIF(n{c} - 1, 0)" for c in range(k)) + " END"
    others = "least(" + ", ".join(f"CASE WHEN cluster <> {c} THEN g{c} END" for c in range(k)) + ")"
    return f"""
    u{k} AS MATERIALIZED (SELECT {middle}, {sizes} FROM a{k}),
    w{k} AS MATERIALIZED (SELECT {around} FROM a{k}, u{k}),
    v{k} AS (
      SELECT {k}::BIGINT AS k, {r('CAST(SUM(CAST(floor(n * off * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / 1e6', 4)} AS inertia,
        {r('CAST(SUM(CAST(floor(n * COALESCE((b - a) / NULLIF(greatest(a, b), 0), 0) * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / 1e6 / CAST(SUM(n) AS DOUBLE)', 6)} AS silhouette
      FROM (SELECT n, off, {inside} AS a, CASE WHEN {inside} IS NOT NULL THEN {others} END AS b
        FROM (SELECT n, off, cluster, u{k}.*, {from_each} FROM a{k}, u{k}, w{k})))"""


def _profiles() -> str:
    def mean(f: str) -> str:
        return q(f"SUM({f} * n)", "SUM(n)")

    shares = (("avg_duration", "duration_min"), ("avg_hour", "hour_of_day"), ("pct_weekend", "is_weekend"),
              ("pct_summer", "is_summer"), ("pct_ebike", "is_ebike"), ("pct_peak_hr", "is_peak_hr"))
    first = " UNION ALL ".join(
        f"SELECT {i} AS turn, '{name}' AS persona, arg_max(cluster, {share} * 1000 - cluster) AS cluster FROM profile"
        for i, (name, share) in enumerate(NAMED_BY))
    return f"""{_points()}, {_fit(4, 20, 4)},
    profile AS MATERIALIZED (
      SELECT cluster, CAST(SUM(n) AS BIGINT) AS rides, {', '.join(f'{r(mean(f), 2)} AS {name}' for name, f in shares)},
        {r(q('CAST(SUM(cents) AS DOUBLE) / 100', 'SUM(priced)'), 2)} AS avg_cost,
        {r(q('SUM(n) * 100', 'SUM(SUM(n)) OVER ()'), 1)} AS pct_of_casual FROM a4 GROUP BY cluster),
    label AS MATERIALIZED (SELECT cluster, arg_max(persona, turn) AS persona FROM ({first}) GROUP BY cluster)"""


def _axes() -> str:
    """ax: the two axes of most variance, by squaring the matrix of products until one column is left."""
    def largest(matrix: str, name: str) -> str:
        return f"""
    {name}p AS (SELECT 0 AS step, i, j, v FROM {matrix} UNION ALL
      SELECT step + 1, i, j, v / MAX(abs(v)) OVER () FROM (
        SELECT ANY_VALUE(a.step) AS step, a.i, b.j, SUM(a.v * b.v) AS v FROM {name}p a JOIN {name}p b ON a.j = b.i
        WHERE a.step < 40 GROUP BY a.i, b.j)),
    {name}c AS MATERIALIZED (SELECT i, v FROM {name}p WHERE step = 40 AND j = (
      SELECT arg_max(i, v) FROM {name}p WHERE step = 40 AND i = j)),
    {name} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(SUM(v * v)) FROM {name}c) * (SELECT sign(arg_max(v, abs(v))) FROM {name}c) AS v FROM {name}c),
    {name}l AS MATERIALIZED (SELECT SUM(a.v * m.v * b.v) AS size FROM {matrix} m JOIN {name} a ON a.i = m.i JOIN {name} b ON b.i = m.j)"""
    z = [f"COALESCE((x{i} - m{i}) / d{i}, 0)" for i in DIMS]
    cells = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, SUM({z[i]} * {z[j]} * n) / SUM(n) AS v FROM pt" for i in DIMS for j in DIMS)
    return f"""
    mx AS MATERIALIZED ({cells}), {largest('mx', 'one')},
    my AS MATERIALIZED (SELECT m.i, m.j, m.v - size * a.v * b.v AS v FROM mx m JOIN one a ON a.i = m.i JOIN one b ON b.i = m.j, onel),
    {largest('my', 'two')}"""


def cluster_queries() -> dict[str, str]:
    ks = range(2, 8)
    sweep = ",".join(f"{_fit(k, 10, 7)}, {_silhouette(k)}" for k in ks)
    base = _profiles()

    def mean(f: str) -> str:
        return q(f"SUM({f} * n)", "SUM(n)")

    scales = (("duration", "duration_min", "/ 3.0::DOUBLE"), ("hour", "hour_of_day", "/ 2.4::DOUBLE"), ("weekend", "is_weekend", "* 10"),
              ("summer", "is_summer", "* 10"), ("ebike", "is_ebike", "* 10"))
    scaled = ", ".join(f"{r(f'{mean(f)} {s}', 4)} AS {name}" for name, f, s in scales)
    centres = ", ".join(
        r("CASE cluster " + " ".join(f"WHEN {c} THEN ANY_VALUE(c{c}_{i})" for c in range(4)) + " END", 6) + f" AS {f}"
        for i, f in enumerate(FEATURES))
    z = [f"COALESCE((x{i} - m{i}) / d{i}, 0)" for i in DIMS]
    along = {name: " + ".join(f"{z[i]} * (SELECT v FROM {name} WHERE i = {i})" for i in DIMS) for name in ("one", "two")}
    parts = ", ".join(f"{r(along[name], 6)} AS pc{c}" for c, name in ((1, "one"), (2, "two")))
    explained = ", ".join(
        f"{r(f'(SELECT size FROM {name}l) / (SELECT SUM(v) FROM mx WHERE i = j)', 6)} AS pc{c}_variance_share"
        for c, name in ((1, "one"), (2, "two")))
    return {
        "cluster_k_sweep": f"""{_points()}, {sweep},
    every_k AS ({' UNION ALL '.join(f'SELECT * FROM v{k}' for k in ks)})
    SELECT *, silhouette = MAX(silhouette) OVER () AS is_best FROM every_k""",
        "cluster_profiles": f"{base} SELECT * FROM profile",
        "cluster_centres": f"""{base} SELECT cluster, CAST(SUM(n) AS BIGINT) AS rides, {centres},
      {r(q('CAST(SUM(CAST(floor(n * off * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / 1e6', 'SUM(n)'), 6)} AS mean_square FROM a4 GROUP BY cluster""",
        "cluster_labels": f"{base} SELECT cluster, persona, rides, pct_of_casual FROM profile LEFT JOIN label USING (cluster)",
        "persona_feature_profile": f"""{base} SELECT persona, CAST(SUM(n) AS BIGINT) AS rides, {scaled},
      {r(q('CAST(SUM(cents) AS DOUBLE) / 100', 'SUM(priced)'), 4)} AS cost FROM a4 JOIN label USING (cluster) GROUP BY persona""",
        "cluster_projection": f"""{base}, {_axes()}
    SELECT ft.ride_id, cluster, persona, {parts}, {explained} FROM ft JOIN a4 USING ({', '.join(FEATURES)}) LEFT JOIN label USING (cluster)""",
    }
