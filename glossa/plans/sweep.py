"""SQL for cross-validated least squares: one scan sums products of centred columns, and
a recursive query sweeps each formula's training matrix, pivot after pivot."""

from __future__ import annotations


def sweep_sql(design: str, terms: list[str], response: str, formulas: dict[str, list[str]]) -> str:
    """Common table expressions that end in ll(formula, fold, n_train, n_test, ll_mean,
    ll_sum), over a table design(fold, columns...). Term a:b is a product.

    Sweeping the pivots of a symmetric matrix of products leaves the coefficients in the
    response's column and the residual sum of squares in its corner."""
    size = len(terms) + 2
    column = lambda t: " * ".join(p + "::DOUBLE" for p in t.split(":"))
    named = ", ".join(f"{column(t)} AS x{k}" for k, t in enumerate([*terms, response], 1))
    centred = ", ".join(f"x{k} - avg(x{k}) OVER () AS z{k}" for k in range(1, size))
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    place = {c: k for k, c in enumerate(cells, 1)}
    at = lambda i, j: place[min(i, j), max(i, j)]
    sums = ", ".join(f"sum({'1.0::DOUBLE' if i == j == 0 else f'z{j}' if i == 0 else f'z{i} * z{j}'})" for i, j in cells)
    numbers = {t: k for k, t in enumerate(terms, 1)}
    rows = []
    for name, use in formulas.items():
        chosen = [0, *[numbers[t] for t in use], size - 1]
        rows.append(f"('{name}', {len(chosen)}, [{', '.join(str(at(i, j)) for i in chosen for j in chosen)}])")
    swept = """list_transform(range(m * m), lambda t: CASE
      WHEN t // m = k AND t % m = k THEN 1 / s[k * m + k + 1]
      WHEN t // m = k THEN s[t + 1] / s[k * m + k + 1]
      WHEN t % m = k THEN -s[t + 1] / s[k * m + k + 1]
      ELSE s[t + 1] - s[(t // m) * m + k + 1] * s[k * m + t % m + 1] / s[k * m + k + 1] END)"""
    return f"""
columns_ AS (SELECT fold, {named} FROM {design}),
centred AS (SELECT fold, {centred} FROM columns_),
folds_ AS (SELECT fold, [{sums}] AS g FROM centred GROUP BY fold),
whole_ AS (SELECT list(v ORDER BY k) AS g FROM (SELECT k, sum(v) AS v FROM (SELECT unnest(g) AS v, generate_subscripts(g, 1) AS k FROM folds_) GROUP BY k)),
formulas_(formula, m, cells) AS (VALUES {', '.join(rows)}),
chosen AS (
  SELECT formula, fold, m, list_transform(cells, lambda c: w.g[c] - f.g[c]) AS train, list_transform(cells, lambda c: f.g[c]) AS held FROM formulas_, folds_ f, whole_ w),
sweep AS (
  SELECT formula, fold, m, 0 AS k, train AS s FROM chosen
  UNION ALL SELECT formula, fold, m, k + 1, {swept} FROM sweep WHERE k < m - 1),
fits AS (
  SELECT formula, fold, c.m, train, held, s[c.m * c.m] AS rss, list_concat(list_transform(range(c.m - 1), lambda i: s[(i + 1) * c.m]), [-1.0::DOUBLE]) AS b
  FROM chosen c JOIN sweep w USING (formula, fold) WHERE k = c.m - 1),
errors AS (
  SELECT formula, fold, train[1] AS n_train, held[1] AS n_test, rss / train[1] AS v, list_sum(list_transform(range(m * m), lambda t: held[t + 1] * b[t // m + 1] * b[t % m + 1])) AS e FROM fits),
ll AS (
  SELECT formula, fold, round(n_train)::BIGINT AS n_train, round(n_test)::BIGINT AS n_test, -0.5::DOUBLE * ln(2 * pi() * v) - e / (2 * v * n_test) AS ll_mean,
    -0.5::DOUBLE * n_test * ln(2 * pi() * v) - e / (2 * v) AS ll_sum FROM errors)"""
