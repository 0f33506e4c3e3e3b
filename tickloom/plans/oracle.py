"""The queries' ANSI SQL for a second engine, put together from named common table expressions."""

from __future__ import annotations

CTE: dict[str, str] = {}
SQL: dict[str, str] = {}


def w(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


T = "OVER (PARTITION BY ticker ORDER BY d)"
RUN = "OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def decayed(y: str, b: float) -> str:
    return f"pow({b!r}, t) * sum(({y}) * pow({b!r}, -CAST(t AS DOUBLE))) {RUN}"


def ema(x: str, span: int) -> str:
    a = 2.0 / (span + 1)
    return decayed(f"CASE WHEN t = 0 THEN {x} ELSE ({x}) * {a!r} END", 1 - a)


def wilder(x: str, n: int) -> str:
    first = f"sum(CASE WHEN t < {n} THEN {x} END) OVER (PARTITION BY ticker)"
    b = 1 - 1.0 / n
    return f"CASE WHEN t < {n} THEN {first} ELSE pow({b!r}, t - {n - 1}) * {first} + pow({b!r}, t) * sum(CASE WHEN t >= {n} THEN ({x}) * pow({b!r}, -CAST(t AS DOUBLE)) ELSE 0e0 END) {RUN} END"


def full(agg: str, n: int) -> str:
    return f"CASE WHEN t >= {n - 1} THEN {agg} {w(n)} END"


CTE["weeks"] = """SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS d,
  (sum(CAST(round(l_discount*100) AS BIGINT))*1e0/count(*) - 5e0)/1e2 AS r,
  sum(CAST(round(l_tax*100) AS BIGINT))*1e0/count(*)/1e2 AS tx, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
CTE["walk"] = f"SELECT *, 1e2 * exp(sum(r) {T}) AS close FROM weeks"
CTE["opened"] = f"SELECT *, coalesce(lag(close) {T}, 1e2) AS open FROM walk"
CTE["bars"] = f"""SELECT ticker, d, round(open,4) AS open, round(greatest(open,close)*(1+tx/4),4) AS high,
  round(least(open,close)*(1-tx/4),4) AS low, round(close,4) AS close, volume, row_number() {T} - 1 AS t FROM opened"""
CTE["universe"] = """SELECT ticker, n, ticker || ' Corp' AS company_name,
  (['Semiconductors','Utilities','Biotech','Health Care Services','Software'])[n % 5 + 1] AS industry, n % 3 = 0 AS is_etf
  FROM (SELECT p_brand AS ticker, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS n FROM (SELECT DISTINCT p_brand FROM part))"""
CTE["idx"] = f"""SELECT ticker, d, close, row_number() {T} - 1 AS t FROM (SELECT 'INDEX' AS ticker, d,
  round(sum(CAST(round(close*10000) AS BIGINT))*1e0/count(*)/1e4, 4) AS close FROM bars GROUP BY d)"""
CTE["vix"] = f"""SELECT d, CASE WHEN t >= 20 THEN round(stddev_samp(lr) {w(20)} * sqrt(252e0) * 100, 4) END AS vix
  FROM (SELECT *, ln(close / lag(close) {T}) AS lr FROM idx)"""
CTE["m0"] = f"SELECT *, lag(close) {T} AS pc, lag(high) {T} AS ph, lag(low) {T} AS pl FROM bars"
CTE["m1"] = """SELECT *, CASE WHEN pc > 0 THEN close / pc - 1 END AS ret, coalesce(greatest(close - pc, 0e0), 0e0) AS gain,
  coalesce(greatest(pc - close, 0e0), 0e0) AS loss,
  CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  coalesce(round(high - ph, 8), 0e0) AS up, coalesce(round(pl - low, 8), 0e0) AS down FROM m0"""
CTE["m2"] = "SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0e0 END AS dmp FROM m1"
CTE["m3"] = "SELECT *, CASE WHEN down > dmp AND down > 0 THEN down ELSE 0e0 END AS dmm FROM m2"
CTE["r1"] = f"""SELECT *, {ema('gain', 14)} AS ag, {ema('loss', 14)} AS al, {ema('tr', 14)} AS atr_14, {ema('close', 20)} AS ema_20,
  {ema('close', 12)} AS e12, {ema('close', 26)} AS e26, {wilder('tr', 14)} AS str, {wilder('dmp', 14)} AS sp, {wilder('dmm', 14)} AS sm,
  avg(CASE WHEN t >= 1 THEN tr END) {w(14)} AS seed FROM m3"""
CTE["r2"] = f"""SELECT *, CASE WHEN al <> 0 THEN 100 - 100 / (1 + ag / al) END AS rsi_14, e12 - e26 AS macd,
  100 * sp / nullif(str, 0) AS di_plus, 100 * sm / nullif(str, 0) AS di_minus,
  CASE WHEN t >= 14 THEN {decayed('CASE WHEN t < 14 THEN 0e0 WHEN t = 14 THEN seed ELSE tr / 14 END', 13 / 14)} END AS atr_wilder FROM r1"""
CTE["r3"] = "SELECT *, coalesce(100 * abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0), 0e0) AS dx FROM r2"
CTE["r4"] = f"SELECT *, {ema('macd', 9)} AS macd_signal, ({wilder('dx', 14)}) / 14 AS adx_14 FROM r3"
CTE["i1"] = f"""SELECT *, macd - macd_signal AS macd_hist, t + 1 AS n_bars, avg(close) {w(50)} AS dma_50, avg(close) {w(200)} AS dma_200,
  {full('avg(close)', 20)} AS sma_20, {full('avg(close)', 50)} AS sma_50, {full('avg(close)', 200)} AS sma_200,
  avg(volume) {w(20)} AS volume_ma_20, {full('avg(volume)', 20)} AS vfull, {full('stddev_samp(close)', 20)} AS dev,
  {full('max(high)', 20)} AS high_20, {full('max(high)', 252)} AS high_252, {full('min(low)', 10)} AS low_10, {full('min(low)', 20)} AS low_20,
  {full('min(rsi_14)', 10)} AS rsi_min_10, {full('min(rsi_14)', 5)} AS rsi_min_5,
  (CASE WHEN lag(close, 62) {T} > 0 THEN close / lag(close, 62) {T} END - 1) * 100 AS return_63,
  min(ret) {w(5)} AS worst_5, max(ret) {w(5)} AS best_5, avg(high - low) {w(14)} AS spread,
  coalesce(low < lag(low, 1) {T} AND low < lag(low, 2) {T} AND low < lead(low, 1) {T} AND low < lead(low, 2) {T}, false) AS is_low FROM r4"""
CTE["ind"] = f"""SELECT *, CASE WHEN vfull > 0 THEN volume / vfull ELSE 0e0 END AS volume_ratio, sma_20 + 2 * dev AS bb_up, sma_20 - 2 * dev AS bb_low,
  CASE WHEN dev = 0 THEN 0.5e0 ELSE (close - (sma_20 - 2 * dev)) / ((sma_20 + 2 * dev) - (sma_20 - 2 * dev)) END AS bb_position,
  CASE WHEN t >= 13 AND spread > 0 THEN spread ELSE close * 0.02e0 END AS atr_proxy,
  CASE WHEN high_20 > 0 THEN (high_20 - close) / high_20 * 100 END AS from_high_20,
  CASE WHEN t >= 19 THEN coalesce({', '.join(f'CASE WHEN lag(is_low, {k}) {T} AND lag(low, {k}) {T} < close THEN lag(low, {k}) {T} END' for k in range(2, 18))}) END AS swing_low FROM i1"""
CTE["sig"] = """SELECT *, round(entry + 3 * (entry - stop), 2) AS target FROM (
  SELECT ticker, d, t, round(high * 1.001e0, 2) AS entry, swing_low AS stop FROM (SELECT *, max(t) OVER (PARTITION BY ticker) AS last FROM ind)
  WHERE t >= 200 AND t <= last - 1 AND swing_low IS NOT NULL AND close > dma_50 AND dma_50 > dma_200 AND rsi_min_10 < 45 AND rsi_14 BETWEEN 45 AND 65 AND volume > volume_ma_20)
  WHERE stop < entry"""


def trades(signals: str, idealised: bool = False) -> str:
    """SQL of simulated trades over a CTE of signals."""
    fill = "s.entry" if idealised else "greatest(s.entry, b.open)"
    price = "CASE WHEN loss THEN stop ELSE target END" if idealised else "CASE WHEN gap_down OR gap_up THEN open WHEN loss THEN stop ELSE target END"
    cost = "0e0" if idealised else "0.1e0"
    return f"""SELECT s.*, x.entry_t, x.fill, x.outcome, x.holding, x.exit, x.return_pct FROM {signals} s LEFT JOIN (
  SELECT ticker, t, entry_t, fill, CASE WHEN loss THEN 'loss' ELSE 'win' END AS outcome, bt - entry_t AS holding, price AS exit, (price / fill - 1) * 100 - {cost} AS return_pct FROM (
    SELECT *, {price} AS price FROM (
      SELECT *, CASE WHEN gap_down THEN true WHEN gap_up THEN false ELSE low <= stop END AS loss FROM (
        SELECT f.*, b.t AS bt, b.open, b.high, b.low, b.t > f.entry_t AND b.open <= f.stop AS gap_down, b.open >= f.target AS gap_up
        FROM (SELECT s.*, b.t AS entry_t, {fill} AS fill FROM {signals} s JOIN bars b ON s.ticker = b.ticker AND b.t > s.t AND b.t <= s.t + 5 AND b.high >= s.entry
              QUALIFY row_number() OVER (PARTITION BY s.ticker, s.t ORDER BY b.t) = 1) f
        JOIN bars b ON f.ticker = b.ticker AND b.t >= f.entry_t AND (b.low <= f.stop OR b.high >= f.target)
        QUALIFY row_number() OVER (PARTITION BY f.ticker, f.t ORDER BY b.t) = 1)))) x ON s.ticker = x.ticker AND s.t = x.t"""


CTE["trades"] = trades("sig")
METRICS = """count(*) AS total_signals, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses,
  coalesce(round(avg(return_pct), 4), 0e0) AS expectancy_pct, coalesce(round(median(holding), 1), 0e0) AS median_holding,
  coalesce(round(median(return_pct) FILTER (outcome = 'win'), 4), 0e0) AS median_win_return,
  coalesce(round(count(*) FILTER (outcome = 'win') * 1e2 / nullif(count(*) FILTER (outcome IS NOT NULL), 0), 2), 0e0) AS win_rate"""
CTE["metrics"] = f"""SELECT u.ticker, u.industry, coalesce(total_signals, 0) AS total_signals, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses,
  coalesce(expectancy_pct, 0e0) AS expectancy_pct, coalesce(median_holding, 0e0) AS median_holding, coalesce(median_win_return, 0e0) AS median_win_return,
  coalesce(win_rate, 0e0) AS win_rate FROM universe u LEFT JOIN (SELECT ticker, {METRICS} FROM trades GROUP BY ticker) m ON u.ticker = m.ticker"""


def needed(text: str) -> list[str]:
    """The named expressions that a text refers to, in an order in which each comes after those that it uses."""
    import re

    order: list[str] = []

    def visit(body: str) -> None:
        for name in CTE:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
                visit(CTE[name])
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def query(text: str) -> str:
    """A whole statement for a final SELECT over the named expressions."""
    names = needed(text)
    return ("WITH " + ",\n".join(f"{n} AS (\n{CTE[n]})" for n in names) + "\n" if names else "") + text
