"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark plans, straight from the definitions:
gap spines with ``generate_series``, ordered-aggregate "first", window
frames, a sparse dot product for the hashed embeddings, and an exhaustive
pair table for exact top-k.  The tables are DuckDB views with the test-table
names.  Rounding matches the registry: 6 decimals on order-dependent sums,
``pow`` and ``product`` results; 9 decimals on distances.
"""

from __future__ import annotations

# Values the results must show, stated here once more and not read from the
# code under test: the reference's parameters, labels and formats, the test
# queries' parameters, and the library's own defaults.
LIBRARY_AMOUNT, APP_AMOUNT, APP_ANNUAL, MONTHS, WEEKS = 1000.0, 2000.0, 0.05, 12, 52
DIM, K, SMALL_K, CHUNK = 384, 2, 50, 1024
SCAN_START, SCAN_END, FALLBACK_START = "1996-01-01", "1998-01-01", "1997-01-01"
RANGE_START, RANGE_END, RANGE_AMOUNT, RANGE_ANNUAL = "1996-03-15", "2000-06-01", 2500.0, 0.04
SEPARATOR, HEADINGS = "\n---\n", ("CONTEXTO EDUCATIVO (RAG):", "ESTADO ACTUAL DE LA CARTERA:")
PREAMBLE = "Responde solo con los datos de las dos secciones siguientes."
GREETING = "Escribe tu pregunta para empezar la conversación."
MONEY, CURRENCY, DEVALUATION, ROI = "$", " MXN", " devaluación", " ROI Estrategia"
TOTAL_LABEL, PEAK_LABEL = "Total Invertido (DCA): ", "Valor de la Cartera Hoy: "
NOTE = "NOTA: Evalúa siempre cómo afecta la inflación a tus finanzas a largo plazo."
NO_METRICS = "Métricas actuales no disponibles."


def rate(annual: float, n: int) -> float:
    return (1.0 + annual) ** (1.0 / n) - 1.0


def lit(s: str) -> str:
    """SQL string literal (E-string, so newlines survive)."""
    return "E'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def num(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
FWD = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"

LI_OBS = """SELECT CAST(l_partkey AS VARCHAR) AS series_key, l_shipdate AS ts, l_orderkey AS t1,
       CAST(l_linenumber AS BIGINT) AS t2, l_extendedprice / l_quantity AS price FROM lineitem"""
BRAND_OBS = """SELECT p_brand AS series_key, l_shipdate AS ts, l_orderkey AS t1,
       CAST(l_linenumber AS BIGINT) AS t2, l_extendedprice / l_quantity AS price
       FROM lineitem JOIN part ON l_partkey = p_partkey"""
EV_OBS = """SELECT CAST(user_id AS VARCHAR) AS series_key, ts, CAST(0 AS BIGINT) AS t1, CAST(0 AS BIGINT) AS t2,
       "value" AS price FROM events"""

PERIOD = {"month": "CAST(date_trunc('month', ts) AS DATE)", "week": "CAST(date_trunc('week', ts) AS DATE)",
          "day": "CAST(ts AS DATE)"}
STEP = {"month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAY", "day": "INTERVAL 1 DAY"}

CPI = """cpi_tab AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period,
                  round(avg(o_totalprice) / 1000.0, 6) AS cpi FROM orders GROUP BY 1)"""


def periods_cte(obs: str, unit: str = "month") -> str:
    """CTEs ``obs, firsts, bounds, spine, periods(series_key, period, price)``."""
    return f"""obs AS ({obs}),
firsts AS (SELECT series_key, {PERIOD[unit]} AS period,
                  first(price ORDER BY ts, t1, t2, price) FILTER (WHERE price IS NOT NULL) AS price
           FROM obs GROUP BY 1, 2),
bounds AS (SELECT series_key, min(period) AS lo, max(period) AS hi FROM firsts GROUP BY 1),
spine AS (SELECT series_key, CAST(p AS DATE) AS period
          FROM bounds, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), {STEP[unit]})) AS t(p)),
periods AS (SELECT s.series_key, s.period, f.price FROM spine s LEFT JOIN firsts f USING (series_key, period))"""


def ledger_cpi_cte(obs: str = LI_OBS, amount: float = LIBRARY_AMOUNT) -> str:
    a = num(amount)
    return f"""{periods_cte(obs)},
{CPI},
l1 AS (SELECT p.series_key, p.period, p.price,
              CASE WHEN p.price <> 0 THEN {a} / p.price END AS units,
              {a} * row_number() OVER (PARTITION BY p.series_key ORDER BY p.period) AS nominal,
              c.cpi AS cpi_raw
       FROM periods p LEFT JOIN cpi_tab c USING (period)),
l2 AS (SELECT *,
              CASE WHEN units IS NOT NULL THEN sum(units) OVER (PARTITION BY series_key ORDER BY period {RUN}) END AS units_cum,
              coalesce(last_value(cpi_raw IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY period {RUN}),
                       first_value(cpi_raw IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY period {FWD})) AS cpi,
              last_value(cpi_raw IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY period {ALL}) AS cpi_now
       FROM l1),
l3 AS (SELECT *, units_cum * price AS value, {a} * (cpi / nullif(cpi_now, 0)) AS real_contrib FROM l2),
ledger AS (SELECT *, CASE WHEN real_contrib IS NOT NULL
                          THEN sum(real_contrib) OVER (PARTITION BY series_key ORDER BY period {RUN}) END AS real_cum
           FROM l3)"""


def ledger_fixed_cte(obs: str = LI_OBS, unit: str = "month", amount: float = APP_AMOUNT,
                     annual: float = APP_ANNUAL) -> str:
    a = num(amount)
    r = num(1.0 + rate(annual, {"month": MONTHS, "week": WEEKS}[unit]))
    return f"""{periods_cte(obs, unit)},
f1 AS (SELECT series_key, period, price,
              coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY period {RUN}),
                       first_value(price IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY period {FWD})) AS pf,
              {a} * row_number() OVER (PARTITION BY series_key ORDER BY period) AS nominal,
              row_number() OVER (PARTITION BY series_key ORDER BY period) - 1 AS n
       FROM periods),
f2 AS (SELECT *, CASE WHEN pf <> 0 THEN {a} / pf END AS units FROM f1),
f3 AS (SELECT *, CASE WHEN units IS NOT NULL THEN sum(units) OVER (PARTITION BY series_key ORDER BY period {RUN}) END AS units_cum FROM f2),
fixed AS (SELECT series_key, period, nominal, nominal / pow({r}, n) AS "real", units_cum * pf AS value FROM f3)"""


def embed_cte(name: str, table: str, keys: list[str], text: str = "text", where: str = "") -> str:
    """``{name}_w(keys..., bucket, w)`` float32-rounded weights and ``{name}_n(keys..., n2)``."""
    k = ", ".join(keys)
    return f"""{name}_tok AS (SELECT {k}, unnest(regexp_split_to_array(lower({text}), '[^\\pL\\pN]+')) AS tok FROM {table} {where}),
{name}_tf AS (SELECT {k}, CAST((CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {DIM}) AS INTEGER) AS bucket,
                     count(*) AS tf FROM {name}_tok WHERE tok <> '' GROUP BY ALL),
{name}_w AS (SELECT {k}, bucket, CAST(CAST(tf / sqrt(sum(tf * tf) OVER (PARTITION BY {k})) AS FLOAT) AS DOUBLE) AS w
             FROM {name}_tf),
{name}_n AS (SELECT {k}, sum(w * w) AS n2 FROM {name}_w GROUP BY ALL)"""


def topk_text_cte(corpus: str, d_key: str, k: int, metric: str = "l2") -> str:
    """Exact top-k of user questions over a hashed corpus: CTE ``ranked``."""
    return f"""{embed_cte('q', 'conversations', ['conv_id', 'turn'], where="WHERE role = 'user'")},
{embed_cte('d', corpus, [d_key])},
dots AS (SELECT q_w.conv_id, q_w.turn, d_w.{d_key}, sum(q_w.w * d_w.w) AS dot
         FROM q_w JOIN d_w USING (bucket) GROUP BY ALL),
pairs AS (SELECT q_n.conv_id, q_n.turn, d_n.{d_key},
                 round(greatest(q_n.n2 + d_n.n2 - 2 * coalesce(dots.dot, 0), 0), 9) AS dist
          FROM q_n CROSS JOIN d_n LEFT JOIN dots USING (conv_id, turn, {d_key})),
ranked AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY dist, {d_key}) AS INTEGER) AS rank,
                  {d_key}, dist FROM pairs QUALIFY rank <= {k})"""


def context_sql(corpus: str, d_key: str, k: int = K, with_question: bool = True) -> str:
    qcol = "q.text AS question, " if with_question else ""
    return f"""WITH {topk_text_cte(corpus, d_key, k)}
SELECT q.conv_id, q.turn, {qcol}coalesce(string_agg(c.text, {lit(SEPARATOR)} ORDER BY r.rank), '') AS context
FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') q
LEFT JOIN ranked r USING (conv_id, turn)
LEFT JOIN {corpus} c ON c.{d_key} = r.{d_key}
GROUP BY q.conv_id, q.turn{', q.text' if with_question else ''}"""


def knn_graph_sql(metric: str) -> str:
    if metric == "l2":
        d = "list_sum(list_transform(generate_series(1, len(a.e)), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))"
    else:
        d = "1 - list_cosine_similarity(a.e, b.e)"
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS q_id, b.vec_id, round(greatest({d}, 0), 9) AS dist FROM v a, v b WHERE a.vec_id <> b.vec_id)
SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, dist
FROM pairs QUALIFY rank <= {K}"""


def half_up(x: str, d: int) -> str:
    return f"round(CAST({x} AS DECIMAL(38,10)), {d})"


def money(x: str) -> str:
    return f"({lit(MONEY)} || format('{{:,}}', CAST({half_up(x, 0)} AS HUGEINT)))"


def two_dec(x: str) -> str:
    return f"coalesce(printf('%.2f', {half_up(x, 2)}), 'nan')"


def metrics_block(total: str, peak: str) -> str:
    return (f"{lit(TOTAL_LABEL)} || {two_dec(total)} || {lit(CURRENCY + chr(10))} || "
            f"{lit(PEAK_LABEL)} || {two_dec(peak)} || {lit(CURRENCY + chr(10))} || "
            f"{lit(NOTE)}")


def kpi_cte(ledger: str | None = None) -> str:
    return f"""{ledger or ledger_fixed_cte()},
last_row AS (SELECT series_key, arg_max({{'nominal': nominal, 'real': "real", 'value': value}}, period) AS l,
                    max(period) AS period FROM fixed GROUP BY 1),
snap AS (SELECT series_key, period, l.nominal AS nominal, l."real" AS "real", l.value AS value,
                CASE WHEN l.nominal > 0 THEN (l."real" - l.nominal) / l.nominal * 100.0 ELSE 0.0 END AS devaluation_pct,
                CASE WHEN l.nominal > 0 THEN (l.value - l.nominal) / l.nominal * 100.0 ELSE 0.0 END AS roi_pct
         FROM last_row)"""


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["price_scan"] = f"""SELECT series_key, ts, price FROM ({LI_OBS})
WHERE ts >= TIMESTAMP '{SCAN_START}' AND ts < TIMESTAMP '{SCAN_END}'"""
    s["fallback_source"] = f"SELECT series_key, ts, price FROM ({LI_OBS}) WHERE ts >= TIMESTAMP '{FALLBACK_START}'"
    s["corpus_append"] = """SELECT 'documents' AS origin, doc_id, text FROM documents
UNION ALL SELECT 'benchmark' AS origin, item_id AS doc_id, text FROM benchmark"""
    s["date_spine"] = f"""WITH b AS (SELECT series_key, min({PERIOD['month']}) AS lo, max({PERIOD['month']}) AS hi
           FROM ({LI_OBS}) GROUP BY 1)
SELECT series_key, CAST(p AS DATE) AS period
FROM b, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS t(p)"""
    s["period_first_month"] = f"WITH {periods_cte(LI_OBS)} SELECT * FROM periods"
    s["period_first_week"] = f"WITH {periods_cte(EV_OBS, 'week')} SELECT * FROM periods"
    s["period_first_day"] = f"WITH {periods_cte(EV_OBS, 'day')} SELECT * FROM periods"
    s["cum_units_gappy"] = f"""WITH {ledger_cpi_cte()}
SELECT series_key, period, price, units, round(units_cum, 6) AS units_cum FROM ledger"""
    s["nominal_ladder"] = f"""WITH {periods_cte(LI_OBS)}
SELECT series_key, period, row_number() OVER w AS n_periods, {num(LIBRARY_AMOUNT)} * row_number() OVER w AS nominal
FROM periods WINDOW w AS (PARTITION BY series_key ORDER BY period)"""
    s["ffill_bfill"] = f"""WITH {periods_cte(LI_OBS)}
SELECT series_key, period, price,
       coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY period {RUN}),
                first_value(price IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY period {FWD})) AS price_filled
FROM periods"""
    s["cpi_left_join_fill"] = f"WITH {ledger_cpi_cte()} SELECT series_key, period, cpi_raw, cpi FROM ledger"
    s["cpi_now"] = f"WITH {ledger_cpi_cte()} SELECT series_key, period, cpi, cpi_now FROM ledger"
    s["real_contributions"] = f"""WITH {ledger_cpi_cte()}
SELECT series_key, period, real_contrib, round(real_cum, 3) AS real_cum FROM ledger"""
    dca_cols = """series_key, period, price, units, round(units_cum, 6) AS units_cum, round(value, 3) AS value, nominal,
       cpi, real_contrib, round(real_cum, 3) AS real_cum"""
    s["dca_cpi"] = f"WITH {ledger_cpi_cte()} SELECT {dca_cols} FROM ledger"
    s["dca_cpi_brand"] = f"WITH {ledger_cpi_cte(BRAND_OBS)} SELECT {dca_cols} FROM ledger"
    s["dca_fixed_rate"] = f"""WITH {ledger_fixed_cte()}
SELECT series_key, period, nominal, round("real", 3) AS "real", round(value, 3) AS value FROM fixed"""
    s["dca_fixed_rate_week"] = f"""WITH {ledger_fixed_cte(EV_OBS, 'week')}
SELECT series_key, period, nominal, round("real", 3) AS "real", round(value, 3) AS value FROM fixed"""
    s["total_units"] = f"""WITH {periods_cte(LI_OBS)}
SELECT series_key, round(sum(CASE WHEN price <> 0 THEN {num(LIBRARY_AMOUNT)} / price END), 6) AS total_units
FROM periods GROUP BY 1"""
    s["purchasing_power_decay"] = f"""WITH {ledger_cpi_cte()},
i AS (SELECT series_key, period, nominal,
             coalesce(cpi / nullif(lag(cpi) OVER (PARTITION BY series_key ORDER BY period), 0) - 1, 0.0) AS inflation
      FROM ledger),
d AS (SELECT *, product(1 - inflation) OVER (PARTITION BY series_key ORDER BY period {RUN}) AS decay FROM i)
SELECT series_key, period, nominal, round(inflation, 9) AS inflation, round(decay, 9) AS decay,
       round(nominal * decay, 3) AS "real" FROM d"""
    s["kpi_snapshot"] = f"""WITH {kpi_cte()}
SELECT series_key, period, nominal, round("real", 3) AS "real", round(value, 3) AS value,
       round(devaluation_pct, 6) AS devaluation_pct, round(roi_pct, 6) AS roi_pct FROM snap"""
    s["kpi_labels"] = f"""WITH {kpi_cte()}
SELECT series_key, {money('nominal')} AS nominal_text, {money('"real"')} AS real_text, {money('value')} AS value_text,
       printf('%.1f%%', {half_up('devaluation_pct', 1)}) || {lit(DEVALUATION)} AS devaluation_text,
       printf('%+.1f%%', {half_up('roi_pct', 1)}) || {lit(ROI)} AS roi_text
FROM snap"""
    s["state_metrics"] = f"""WITH {ledger_fixed_cte()}
SELECT series_key, max(nominal) AS total_invested, round(max(value), 3) AS portfolio_peak FROM fixed GROUP BY 1"""
    s["metrics_text"] = f"""WITH {ledger_fixed_cte()},
m AS (SELECT series_key, max(nominal) AS t, max(value) AS p FROM fixed GROUP BY 1)
SELECT series_key, {metrics_block('t', 'p')} AS metrics_text FROM m"""
    s["hash_embed"] = f"""WITH {embed_cte('d', 'documents', ['doc_id'])}
SELECT doc_id, bucket, tf, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS weight FROM d_tf"""
    s["knn_l2_top2"] = knn_graph_sql("l2")
    s["knn_cosine_top2"] = knn_graph_sql("cosine")
    s["knn_small_corpus"] = f"""WITH {topk_text_cte('benchmark', 'item_id', SMALL_K)}
SELECT conv_id, turn, rank, item_id, dist FROM ranked"""
    s["context_concat"] = context_sql("benchmark", "item_id", with_question=False)
    s["doc_retrieval"] = context_sql("documents", "doc_id")
    system = (f"{lit(PREAMBLE + chr(10) + chr(10) + HEADINGS[0] + chr(10))} || ctx.context || "
              f"{lit(chr(10) + chr(10) + HEADINGS[1] + chr(10))} || st.metrics_text || {lit(chr(10))}")
    s["rag_prompts"] = f"""WITH ctx AS ({context_sql('documents', 'doc_id')}),
st AS (WITH {ledger_fixed_cte()} SELECT {metrics_block('max(nominal)', 'max(value)')} AS metrics_text FROM fixed)
SELECT ctx.conv_id, ctx.turn, {system} AS system, ctx.question AS "user" FROM ctx, st"""
    s["rag_prompts_by_session"] = f"""WITH ctx AS ({context_sql('documents', 'doc_id')}),
st AS (WITH {ledger_fixed_cte()} SELECT series_key, {metrics_block('max(nominal)', 'max(value)')} AS metrics_text FROM fixed GROUP BY 1)
SELECT ctx.conv_id, ctx.turn, {system.replace('st.metrics_text', f'coalesce(st.metrics_text, {lit(NO_METRICS)})')} AS system,
       ctx.question AS "user" FROM ctx LEFT JOIN st ON st.series_key = CAST(ctx.conv_id AS VARCHAR)"""
    s["doc_retrieval_blocks"] = s["doc_retrieval"]
    # texts are looked up by row, not by id
    s["doc_retrieval_appended"] = (context_sql("twice", "rid")
        .replace("WITH ", "WITH twice AS (SELECT *, doc_id * 2 + c AS rid FROM documents, range(2) r(c)), ", 1))
    s["price_scan_keys"] = f"SELECT series_key, ts, price FROM ({LI_OBS}) WHERE series_key IN ('1', '7', '42', '150')"
    ranged = f"SELECT * FROM ({LI_OBS}) WHERE ts >= TIMESTAMP '{RANGE_START}' AND ts < TIMESTAMP '{RANGE_END}'"
    snap = """period, nominal, round("real", 3) AS "real", round(value, 3) AS value,
       round(devaluation_pct, 6) AS devaluation_pct, round(roi_pct, 6) AS roi_pct FROM snap"""
    s["backtest_range"] = f"WITH {kpi_cte(ledger_fixed_cte(ranged, 'month', RANGE_AMOUNT, RANGE_ANNUAL))} SELECT series_key, {snap}"
    def plan_sql(plans: str, obs: str, unit: str, per_year: int) -> str:
        ticks = f"""SELECT CAST(p.plan_id AS VARCHAR) AS series_key, o.ts, o.t1, o.t2, o.price FROM plans p JOIN ({obs}) o USING (series_key)
                  WHERE o.ts >= p.lo AND o.ts < p.hi"""
        ledger = (ledger_fixed_cte(ticks, unit)
                  .replace(num(1.0 + rate(APP_ANNUAL, per_year)), f"(1 + (pow(1 + annual, {num(1 / per_year)}) - 1))")
                  .replace(num(APP_AMOUNT), "amount")
                  .replace("FROM periods)", "FROM periods JOIN terms USING (series_key))")
                  .replace("SELECT series_key, period, price,\n              coalesce", "SELECT series_key, period, price, amount, annual,\n              coalesce"))
        return f"""WITH plans AS ({plans}),
terms AS (SELECT CAST(plan_id AS VARCHAR) AS series_key, CAST(amount AS DOUBLE) AS amount, annual FROM plans),
{kpi_cte(ledger)} SELECT CAST(series_key AS BIGINT) AS plan_id, {snap}"""

    s["plan_batch"] = plan_sql("""SELECT c_custkey AS plan_id, CAST(c_custkey AS VARCHAR) AS series_key, 500.0 + 500.0 * (c_custkey % 20) AS amount,
       TIMESTAMP '1995-06-01' + to_months(CAST(c_custkey % 24 AS INTEGER)) AS lo,
       TIMESTAMP '1998-06-01' + to_months(CAST(c_custkey % 24 AS INTEGER)) AS hi, CAST(c_custkey % 10 AS DOUBLE) / 100 AS annual FROM customer""",
                               LI_OBS, "month", MONTHS)
    s["plan_batch_week"] = plan_sql("""SELECT c_custkey AS plan_id, CAST(c_custkey % 150 AS VARCHAR) AS series_key, 100.0 + 10.0 * (c_custkey % 7) AS amount,
       TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 450 AS INTEGER)) AS lo,
       TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 450 + 100 + c_custkey % 300 AS INTEGER)) AS hi,
       CAST(c_custkey % 10 AS DOUBLE) / 100 AS annual FROM customer""", EV_OBS, "week", WEEKS)
    backup = f"SELECT series_key, ts, price FROM ({LI_OBS}) WHERE ts >= TIMESTAMP '{FALLBACK_START}'"
    feed = f"SELECT series_key, ts, price FROM ({LI_OBS}) WHERE ts >= TIMESTAMP '2001-01-01'"
    s["fallback_by_series"] = f"""WITH f AS ({feed}) SELECT *, 'primary' AS origin FROM f
UNION ALL SELECT *, 'backup' AS origin FROM ({backup}) WHERE series_key NOT IN (SELECT series_key FROM f)"""
    s["fallback_empty_primary"] = f"SELECT *, 'backup' AS origin FROM ({backup})"
    s["fallback_primary"] = f"SELECT *, 'primary' AS origin FROM ({feed})"
    s["csv_prices"] = f"SELECT series_key, ts, price, false AS malformed FROM ({LI_OBS})"
    s["csv_cpi_fill"] = s["cpi_left_join_fill"]
    s["text_files"] = "SELECT doc_id, text FROM documents"
    s["knn_appended"] = f"""WITH grown AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark),
{topk_text_cte('grown', 'doc_id', K)}
SELECT conv_id, turn, rank, doc_id, dist FROM ranked"""
    letters = ", ".join(f"len(text) - len(replace(text, '{c}', ''))" for c in "aeiou ")
    s["encode_hook"] = f"""WITH v AS (SELECT doc_id, CAST([{letters}, 1] AS DOUBLE[]) AS v FROM documents)
SELECT doc_id, i AS place, round(CAST(CAST(v[i + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS FLOAT) AS DOUBLE), 5) AS value
FROM v, range(7) r(i)"""
    s["state_metrics_absent"] = f"""WITH {ledger_fixed_cte()}
SELECT series_key, max(nominal) AS total_invested, CAST(0 AS DOUBLE) AS portfolio_peak FROM fixed GROUP BY 1"""
    s["kpi_labels_plus"] = s["kpi_labels"].replace("printf('%+.1f%%'", "'+' || printf('%.1f%%'")
    s["transcript_append"] = f"""SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS turn, 'assistant' AS role,
       {lit(GREETING)} AS text FROM conversations
UNION ALL
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn, role, text
FROM conversations"""
    s["transcript_replay"] = """SELECT conv_id, count(*) AS n_turns,
       string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), E'\\n' ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id"""
    s["transcript_replay_chunks"] = f"""SELECT conv_id, CAST(floor(turn / {CHUNK}) AS BIGINT) AS chunk,
       count(*) AS n_turns, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), E'\\n' ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id, chunk"""
    return s


ORACLE_SQL: dict[str, str] = _sql()
