"""Queries on scalar functions, parsers, the catalogue and web signals, over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import angles, bessel, bits, geometry, text
from tideline.operators import cluster as clustering
from tideline.operators import blocks, features, interpolate, reports, signals
from tideline.plans.base import DAILY, EVENTS, FEATS, GRID, query
from tideline.sources import catalog, files, readers
from tideline.sources.tables import daily, event_grid, event_samples, shots, table
from tideline.sources.tables import features as feature_rows

#: A resultant length in (0, 1) and a concentration above 0 of each event.
R, KAPPA = "value / (value + 50)", "value / 4"


@query(f"SELECT event_id AS id, CASE WHEN r < 0.53 THEN 2 * r + pow(r, 3) + 5 * pow(r, 5) / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / (2 * (1 - r)) END AS kappa FROM (SELECT event_id, {R} AS r FROM events) -- kappa")
def kappa_from_r(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), angles.kappa_from_r(F.expr(R)).alias("kappa"))


@query(f"WITH k AS (SELECT event_id AS id, {KAPPA} AS k FROM events) SELECT id, ({bessel.sql_i0e('k')}) AS i0e, ({bessel.sql_i1e('k')}) AS i1e FROM k -- i0e i1e", digits=6)
def bessel_i0_i1(spark, sf_dir):
    k = F.expr(KAPPA)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), bessel.i0e(k).alias("i0e"), bessel.i1e(k).alias("i1e"))


@query(f"WITH k AS (SELECT event_id AS id, {KAPPA} AS k FROM events) SELECT id, sqrt(-2 * ln(({bessel.sql_i1e('k')}) / ({bessel.sql_i0e('k')}))) AS std, degrees(sqrt(-2 * ln(({bessel.sql_i1e('k')}) / ({bessel.sql_i0e('k')})))) AS degrees FROM k -- std degrees")
def convert_kappa_std(spark, sf_dir):
    k = F.expr(KAPPA)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), bessel.kappa_to_std(k).alias("std"), bessel.kappa_to_std(k, degrees=True).alias("degrees"))


@query("SELECT event_id AS id, ln(value) - 3 AS x, exp(-pow((ln(value) - 3 - 0.3) / 0.7, 2) / 2) / (0.7 * sqrt(2 * pi())) AS density FROM events -- x density")
def normal_pdf(spark, sf_dir):
    x = bessel.ln(F.col("value")) - 3
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), x.alias("x"), bessel.normal_pdf(x, F.lit(0.3), F.lit(0.7)).alias("density"))


@query("SELECT l_orderkey AS id, bit_or(1::BIGINT << (l_suppkey % 60)::INT) AS mask, count(DISTINCT l_suppkey % 60)::INT AS bits FROM lineitem GROUP BY 1")
def list2bin_bin2list(spark, sf_dir):
    """The suppliers of an order as a mask, and back."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_suppkey") % 60).alias("x"))
    rows = rows.select("id", bits.list_to_mask(F.col("x")).alias("mask"))
    return rows.select("id", "mask", F.size(bits.mask_to_list(F.col("mask"))).alias("bits"))


#: A shot text for each order: a range and a number behind it; of every seventh one the range has no end.
SHOTS_SQL = "t AS (SELECT o_orderkey AS id, o_custkey AS a, o_custkey + o_orderkey % 4 AS b, o_custkey + 10 + o_orderkey % 5 AS c, o_orderkey % 7 <> 3 AS ok FROM orders)"


def shot_texts(spark, sf_dir):
    a, b, c = F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey") % 4, F.col("o_custkey") + 10 + F.col("o_orderkey") % 5
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), a.alias("a"), F.concat(a, F.lit(" -"), F.when(F.col("o_orderkey") % 7 != 3, b.cast("string")).otherwise(""), F.lit(", "), c).alias("s"))


@query(f"WITH {SHOTS_SQL} SELECT id, unnest(range(a, b + 1)) AS shot FROM t WHERE ok UNION ALL SELECT id, c FROM t WHERE ok")
def shot_str_parser(spark, sf_dir):
    return shot_texts(spark, sf_dir).select("id", F.explode(text.parse_shots(F.col("s"))).alias("shot"))


@query(f"WITH {SHOTS_SQL} SELECT id, CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END || ',' || c AS text FROM t WHERE ok")
def reverse_shot_str_parser(spark, sf_dir):
    return shot_texts(spark, sf_dir).withColumn("shots", text.parse_shots(F.col("s"))).where("shots IS NOT NULL").select("id", text.shots_to_text(F.col("shots")).alias("text"))


@query(f"WITH {SHOTS_SQL} SELECT id, ok AS valid, ok AND (a + 2 BETWEEN a AND b) AS has_third FROM t")
def in_shot_list(spark, sf_dir):
    return shot_texts(spark, sf_dir).select("id", text.valid_shots(F.col("s")).alias("valid"), text.in_shots(F.col("a") + 2, F.col("s")).alias("has_third"))


@query(f"WITH {SHOTS_SQL} SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM t WHERE ok AND (o.o_orderkey BETWEEN a AND b OR o.o_orderkey = c))")
def in_shot_list_semi(spark, sf_dir):
    """Orders whose number stands in any valid shot text."""
    return text.listed(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", shot_texts(spark, sf_dir), "s")


@query("WITH w AS (SELECT l_orderkey AS id, l_linenumber AS n, l_quantity AS a, 80 * l_discount * 10 AS b FROM lineitem) SELECT id, n, CASE WHEN floor(a) < floor(b + 1e-9) THEN floor(a)::BIGINT END AS t0, CASE WHEN floor(a) < floor(b + 1e-9) THEN floor(b + 1e-9)::BIGINT END AS t1 FROM w")
def time_window_parser(spark, sf_dir):
    """Windows from a quantity to a discount; those that end before they begin are none."""
    s = F.concat(F.col("l_quantity").cast("string"), F.lit(" - "), F.round(F.col("l_discount") * 800, 3).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), text.parse_window(s).alias("w"))
    return rows.select("id", "n", F.get("w", F.lit(0)).alias("t0"), F.get("w", F.lit(1)).alias("t1"))


@query("""WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN ' ' || o_custkey || ' ' WHEN 2 THEN '-' || (o_custkey % 100) || '.5' WHEN 3 THEN '' WHEN 4 THEN o_custkey || 'e3' ELSE 'EM_VMM' END AS s FROM orders)
SELECT id, regexp_full_match(s, '\\s*[+-]?\\d+\\s*') AS is_int, regexp_full_match(s, '\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*') AS is_float, trim(s) IN ('k_means', 'EM_VMM', 'EM_GMM') AS is_method FROM s""")
def validators(spark, sf_dir):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    s = F.when(k == 0, F.col("o_orderpriority")).when(k == 1, F.concat(F.lit(" "), c, F.lit(" "))).when(k == 2, F.concat(F.lit("-"), c % 100, F.lit(".5"))).when(k == 3, "").when(k == 4, F.concat(c, F.lit("e3"))).otherwise("EM_VMM")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), s.alias("s"))
    s = F.col("s")
    return rows.select("id", text.valid_int(s).alias("is_int"), text.valid_float(s).alias("is_float"), text.valid_method(s).alias("is_method"))


@query("SELECT p_partkey AS id, replace(p_name, ' ', '_') AS tree, lower(p_type) AS tag, CASE WHEN p_size > 20 THEN '.' || replace(p_brand, '#', '') || ':ch' || p_size ELSE '' END AS node FROM part")
def mds_path_parse(spark, sf_dir):
    node = F.when(F.col("p_size") > 20, F.concat(F.lit("."), F.regexp_replace("p_brand", "#", ""), F.lit(":ch"), F.col("p_size"))).otherwise("")
    path = F.concat(F.lit("\\"), F.regexp_replace("p_name", " ", "_"), F.lit("::"), F.lower("p_type"), node)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.tree_path(path).alias("z")).select("id", "z.tree", "z.tag", "z.node")


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS k, 'N' || s_nationkey || '_' || s_suppkey || '_MP' AS name FROM supplier), w AS (SELECT *, rpad(name, max(length(name)) OVER (PARTITION BY k)::INT, ' ') AS p FROM s),
b AS (SELECT k, min(p) AS lo, max(p) AS hi FROM w GROUP BY 1), c AS (SELECT k, lo, hi, CASE WHEN lo = hi THEN '' ELSE left(lo, (SELECT max(n) FROM range(200) r(n) WHERE n <= length(lo) AND left(lo, n) = left(hi, n))::INT) END AS prefix FROM b),
r AS (SELECT id, w.k, prefix, reverse(substr(p, length(prefix) + 1)) AS t, lo = hi AS one FROM w JOIN c USING (k)), e AS (SELECT k, min(t) AS lo, max(t) AS hi FROM r GROUP BY 1),
f AS (SELECT k, left(lo, (SELECT max(n) FROM range(200) q(n) WHERE n <= length(lo) AND left(lo, n) = left(hi, n))::INT) AS back FROM e)
SELECT id, prefix, CASE WHEN one THEN '' ELSE reverse(back) END AS suffix, CASE WHEN one THEN reverse(t) ELSE reverse(substr(t, length(back) + 1)) END AS varying FROM r JOIN f USING (k)""")
def split_names(spark, sf_dir):
    """Names of the suppliers of each nation."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), F.concat(F.lit("N"), F.col("s_nationkey"), F.lit("_"), F.col("s_suppkey"), F.lit("_MP")).alias("name"))
    return text.varying_parts(rows, "name", "k").select("id", "prefix", "suffix", "varying")


COILS = {0: (0.002, -0.01, 0.03, -0.28, 0.3, 0.2, 4.1), 1: (0.0, 0.0, 0.5, 0.0, -1.5, 0.25, 1.0), 2: (1.0, -1.0, 1.0, -1.0, 1.0, -1.0, 0.5)}
COIL_SQL = ", ".join(f"({c}, {', '.join(f'{x}::DOUBLE' for x in p)})" for c, p in COILS.items())


@query(f"""WITH c AS (SELECT * FROM (VALUES {COIL_SQL}) v(coil, a, b, c, d, e, f, g)), k AS (SELECT event_id AS id, event_id % 3 AS coil, value / (value + 50) AS k FROM events)
SELECT id, a * pow(k, 6) + b * pow(k, 5) + c.c * pow(k, 4) + d * pow(k, 3) + e * k * k + f * k + g AS c1, 0.0::DOUBLE AS c2 FROM k JOIN c USING (coil) -- c1 c2""")
def coord_transform(spark, sf_dir):
    """Magnetic angle of a coil by its own polynomial."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 3).cast("int").alias("coil"), F.expr(R).alias("kh"))
    known = spark.createDataFrame([(c, list(p)) for c, p in COILS.items()], "coil int, coefficients array<double>")
    return geometry.magnetic_by_coil(rows, known).select("id", "z.c1", "z.c2")


PROBES = " UNION ALL ".join(f"SELECT '{n}' AS probes, unnest(range({len(a)}))::INT AS ch_ix, unnest([{', '.join(map(str, a))}])::DOUBLE AS angle" for n, a in geometry.ARRAYS.items())


@query(f"WITH {EVENTS}, p AS ({PROBES}) SELECT event_id, probes, angle FROM ev JOIN p USING (ch_ix) -- angle")
def probe_positions(spark, sf_dir):
    """The angle at which each event's channel stands, in both arrays."""
    return event_samples(spark, sf_dir).join(geometry.probes(spark), "ch_ix").select("event_id", "probes", "angle")


#: A section for each customer, in a first layer; every fifth one's amplitude is given again in a second.
SECTIONS_SQL = """c AS (SELECT c_custkey, 'c' || c_custkey AS name, CASE WHEN c_custkey % 11 = 3 THEN 'Nonsense' ELSE 'Diagnostic' END AS section_type, c_custkey % 5 = 0 AS again, c_acctbal AS amplitude, c_nationkey AS n, c_custkey % 2 = 0 AS on_ FROM customer)"""


def options(spark, sf_dir):
    key, kind = F.col("c_custkey"), F.when(F.col("c_custkey") % 11 == 3, "Nonsense").otherwise("Diagnostic")
    head = F.concat(F.lit("["), kind, F.lit(":c"), key, F.lit("]"))
    first = F.array(head, F.lit("data_fetcher: sine"), F.concat(F.lit("amplitude = "), F.col("c_acctbal")), F.lit("# a comment"), F.concat(F.lit("N="), F.col("c_nationkey")), F.concat(F.lit("on = "), F.when(key % 2 == 0, "yes").otherwise("no")))
    rows = table(spark, sf_dir, "customer")
    types = spark.createDataFrame([(0, -9 + i, s) for i, s in enumerate(("[variabletypes]", "Diagnostic__amplitude = float", "Diagnostic__n = int", "Diagnostic__on = bool"))], "layer int, line_no long, line string")
    lines = rows.select(F.lit(0).alias("layer"), key.alias("k"), F.posexplode(first).alias("i", "line")).unionByName(rows.where("c_custkey % 5 = 0").select(F.lit(1).alias("layer"), key.alias("k"), F.posexplode(F.array(head, F.concat(F.lit("amplitude = "), F.col("c_acctbal") + 1))).alias("i", "line")))
    return catalog.merged(catalog.parse(types.unionByName(lines.select("layer", (F.col("k") * 10 + F.col("i")).alias("line_no"), "line"))))


@query(f"""WITH {SECTIONS_SQL}, t AS (SELECT name, 'amplitude' AS option, 'float' AS kind, amplitude + CASE WHEN again THEN 1 ELSE 0 END AS number, '' AS flag, section_type FROM c UNION ALL SELECT name, 'n', 'int', n, '', section_type FROM c
UNION ALL SELECT name, 'on', 'bool', NULL, on_::VARCHAR, section_type FROM c UNION ALL SELECT name, 'data_fetcher', 'str', NULL, '', section_type FROM c) SELECT name, option, kind, number, flag FROM t WHERE section_type = 'Diagnostic' -- number""")
def cfg_get(spark, sf_dir):
    return catalog.typed(options(spark, sf_dir)).where("section_type = 'Diagnostic'").select("name", "option", "kind", "number", F.coalesce(F.col("flag").cast("string"), F.lit("")).alias("flag"))


@query(f"WITH {SECTIONS_SQL} SELECT section_type, count(*)::INT AS sections, count(*) * 4 AS options FROM c GROUP BY 1 UNION ALL SELECT 'variabletypes', 1, 3")
def cfg_read(spark, sf_dir):
    return options(spark, sf_dir).groupBy("section_type").agg(F.countDistinct("name").cast("int").alias("sections"), F.count(F.lit(1)).alias("options"))


@query(f"WITH {SECTIONS_SQL} SELECT section_type, name FROM c WHERE section_type = 'Nonsense'")
def cfg_validate(spark, sf_dir):
    return catalog.invalid_sections(options(spark, sf_dir))


@query(f"WITH {SECTIONS_SQL} SELECT name FROM c WHERE section_type = 'Diagnostic'")
def catalog_scan(spark, sf_dir):
    return catalog.scan(options(spark, sf_dir))


@query(f"WITH {GRID} SELECT 9::BIGINT AS shot, 4 - ch_ix AS ch_ix, count(*) AS n, max(abs(value)) AS peak, sum(value) AS total FROM grid GROUP BY ALL -- peak total", digits=3)
def src_getdata(spark, sf_dir):
    """An array from the catalogue: its channels in numeric order, fetched by their source, which reads a given table."""
    lines = [f"[Diagnostic:d{c}]\ndata_fetcher = table_channel\npath = {sf_dir}\nchannel = {c}\n" for c in range(5)]
    text_ = "[variabletypes]\nDiagnostic__channel = int\n" + "".join(lines) + "[Diagnostic:array]\n" + "".join(f"channel_{5 - c} = d{c}\n" for c in range(5))
    rows = catalog.fetch(spark, catalog.Catalog.from_texts(spark, text_), "array", 9)
    return rows.groupBy("shot", "ch_ix").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("peak"), F.sum("value").alias("total"))


@query("""WITH s AS (SELECT o_orderpriority AS scan, o_orderkey * 4 AS a, o_orderkey * 4 + o_custkey % 4 AS b, o_custkey * 0.01::DOUBLE AS e, o_custkey % 3 = 0 AS bad FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')), x AS (SELECT *, unnest(range(a, b + 1)) AS shot FROM s)
SELECT scan, shot, 0.0::DOUBLE AS start_time, e AS end_time FROM x WHERE NOT (bad AND shot = a + 1) -- start_time end_time""")
def src_scan_list(spark, sf_dir):
    """Scans are priorities, with a range of shots for each order; some shots are bad."""
    rows = table(spark, sf_dir, "orders")
    a = F.col("o_orderkey") * 4
    scans = rows.select(F.col("o_orderpriority").alias("name"), a.alias("first_shot"), (a + F.col("o_custkey") % 4).alias("last_shot"), F.lit(0.0).alias("start_time"), (F.col("o_custkey") * 0.01).alias("end_time"))
    bad = rows.where("o_custkey % 3 = 0").select(F.col("o_orderpriority").alias("name"), (a + 1).alias("shot"))
    return catalog.scan_shots(scans, bad, "1-URGENT", "2-HIGH")


@query("SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '?view=xml' WHEN 1 THEN '?a=1&view=xml' ELSE '?view=xml#f' END AS url FROM pages WHERE NOT contains(url, '?') AND NOT contains(url, '#') UNION ALL SELECT page_id, NULL FROM pages WHERE contains(url, '?') OR contains(url, '#')")
def add_query_to_url(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    tail = F.when(F.col("page_id") % 3 == 1, "?a=1").when(F.col("page_id") % 3 == 2, "#f").otherwise("")
    plain = ~F.col("url").contains("?") & ~F.col("url").contains("#")
    return rows.select("page_id", F.when(plain, files.with_query(F.concat("url", tail), "view=xml")).alias("url"))


@query(f"""WITH {EVENTS}, n AS (SELECT shot, ch_ix, row_number() OVER (PARTITION BY shot, ch_ix ORDER BY event_id) - 1 AS i, value FROM ev)
SELECT 's' || shot || 'c' || ch_ix AS name, i AS sample_ix, 0.5 + (shot + 1) * 0.25 * i AS t, ch_ix + 0.1 * (floor(value * 10) - 2500) AS value FROM n -- t value""")
def src_h1ds_http(spark, sf_dir):
    """Events packed as the service sends them: little-endian 16-bit samples, and an XML header that says how they are scaled."""
    rows = event_samples(spark, sf_dir).groupBy("shot", "ch_ix").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("z"))
    raw = F.transform("z", lambda z: (F.floor(z["value"] * 10) - 2500).cast("int"))
    byte = lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")
    content = F.unhex(F.array_join(F.transform(raw, lambda x: F.concat(byte(x), byte(F.floor(x / 256)))), ""))
    header = F.concat(F.lit("<signal><signal_min>"), F.col("ch_ix"), F.lit("</signal_min><signal_delta>0.1</signal_delta><dim_t0>0.5</dim_t0><dim_delta>"), (F.col("shot") + 1) * 0.25, F.lit("</dim_delta></signal>"))
    sent = rows.select(F.concat(F.lit("s"), F.col("shot"), F.lit("c"), F.col("ch_ix")).alias("name"), content.alias("content"), header.alias("xml"))
    return files.web_signals(files.web_headers(sent))


@query(f"WITH {EVENTS}, {DAILY} SELECT shot, ch_ix, t, value FROM ev UNION ALL SELECT shot, ch_ix, t, value FROM daily -- t value")
def common_keys(spark, sf_dir):
    """Two relations on the columns that both have."""
    a, b = event_samples(spark, sf_dir), daily(spark, sf_dir)
    both = signals.common_columns(a, b)
    return a.select(*both).unionByName(b.select(*both))


@query(f"WITH {DAILY}, n AS (SELECT shot, ch_ix, count(*) AS n FROM daily WHERE t >= 0 AND t < 100 GROUP BY ALL) SELECT shot, ch_ix, n, place, step, args FROM n, (VALUES (0, 'reduce_time', '0.0, 100.0'), (1, 'subtract_mean', ''), (2, 'normalise', '''rms''')) v(place, step, args)")
def history(spark, sf_dir):
    """What was done to each channel, and how many samples it has left."""
    s = signals.Signals(daily(spark, sf_dir)).reduce_time(0.0, 100.0).subtract_mean().normalise("rms")
    steps = spark.createDataFrame([(i, name, args) for i, (name, args, _) in enumerate(s.history)], "place int, step string, args string")
    return s.samples.groupBy("shot", "ch_ix").agg(F.count(F.lit(1)).alias("n")).join(steps, how="cross").select("shot", "ch_ix", "n", "place", "step", "args")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 3 AS k FROM orders), d AS (SELECT * FROM (VALUES ('n_clusters', '16'), ('n_iterations', '20'), ('seed', '743'), ('cutoff_value', '80.0'), ('freq_range', '50-250')) v(name, value))
SELECT id, name, CASE WHEN name = 'seed' THEN c::VARCHAR WHEN name = 'n_clusters' AND k = 1 THEN '7' ELSE value END AS value FROM o, d""")
def settings_defaults(spark, sf_dir):
    """Settings texts of the orders, with shortened keys, completed by the defaults."""
    from tideline.plans.mine import settings_table

    body = F.concat(F.lit("see: "), F.col("o_custkey"), F.lit("\nnonsense\nn: 3\n"), F.when(F.col("o_orderkey") % 3 == 1, "n_cl: 7").otherwise("zzz: 1"))
    out = settings_table(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), body.alias("text")), "text")
    return out.where(F.col("name").isin("n_clusters", "n_iterations", "seed", "cutoff_value", "freq_range"))


@query("""WITH l AS (SELECT l_orderkey AS id, list(l_quantity ORDER BY l_quantity) AS x FROM lineitem GROUP BY 1), d AS (SELECT id, list_transform(x, lambda q: abs(q - id % 50)) AS d FROM l) SELECT id, (list_position(d, list_min(d)) - 1)::INT AS nearest FROM d""")
def find_closest(spark, sf_dir):
    """The line of an order whose quantity is nearest to a number."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list("l_quantity")).alias("x"))
    return rows.select("id", interpolate.nearest_index(F.col("x"), F.col("id") % 50).alias("nearest"))


@query("SELECT s_suppkey AS shot, (s_suppkey + 0.5) / (s_suppkey * 2.0 + 1) AS k_par, (s_suppkey + 0.5) / (s_suppkey * 2.0 + 1) * (0.5 / sqrt(1e18 * 2.5 * 1.673e-27 * 4e-7 * pi()) * 0.27) / (2 * pi()) / 1e3 AS freq FROM supplier -- k_par freq")
def rep_alfven(spark, sf_dir):
    """Frequencies at the field ratios of the shots."""
    out = reports.rep_alfven(shots(spark, sf_dir).select("shot", (F.col("sec_current") / F.col("main_current")).alias("k_par")))
    return out.withColumn("freq", F.col("freq") / 1e3)


ANGLES = "CASE WHEN dim % 2 = 0 THEN dim * 0.7 ELSE dim * dim * 0.31 END"


@query(f"""WITH {FEATS}, v AS (SELECT cluster, dim, avg((p.re * r.re + p.im * r.im) / (r.re * r.re + r.im * r.im)) AS re, avg((p.im * r.re - p.re * r.im) / (r.re * r.re + r.im * r.im)) AS im FROM ph p JOIN (SELECT instance_id, re, im FROM ph WHERE dim = 0) r USING (instance_id) GROUP BY ALL),
o AS (SELECT cluster, mode::INT AS mode, atan2(im, re) - mode * ({ANGLES}) AS off FROM v, range(-10, 11) m(mode)), f AS (SELECT cluster, mode, sqrt(pow(sum(cos(off)), 2) + pow(sum(sin(off)), 2)) / count(*) AS fit FROM o GROUP BY ALL)
SELECT cluster, arg_max(mode, (round(fit, 9), -abs(mode))) AS mode, max(fit) AS fit FROM f GROUP BY 1 -- fit""")
def mode_number_fit(spark, sf_dir):
    vectors = features.mean_mode_vector(feature_rows(spark, sf_dir).select("instance_id", "cluster", "amp"))
    angles_ = vectors.select("ch_ix").distinct().withColumn("theta", F.expr(ANGLES.replace("dim", "ch_ix")).cast("double"))
    return features.mode_numbers(vectors, angles_)


@query(f"""WITH {FEATS}, v AS (SELECT cluster, dim, avg((p.re * r.re + p.im * r.im) / (r.re * r.re + r.im * r.im)) AS re, avg((p.im * r.re - p.re * r.im) / (r.re * r.re + r.im * r.im)) AS im FROM ph p JOIN (SELECT instance_id, re, im FROM ph WHERE dim = 0) r USING (instance_id) GROUP BY ALL),
o AS (SELECT cluster, n::INT AS n, m::INT AS m, atan2(im, re) - n * (dim * 0.9) - m * (dim * dim * 0.17) AS off FROM v, range(-5, 6) a(n), range(-8, 9) b(m)), f AS (SELECT cluster, n, m, 1 - sqrt(pow(sum(cos(off)), 2) + pow(sum(sin(off)), 2)) / count(*) AS misfit FROM o GROUP BY ALL)
SELECT cluster, arg_min(n, (round(misfit, 9), abs(n) + abs(m), n, m)) AS n, arg_min(m, (round(misfit, 9), abs(n) + abs(m), n, m)) AS m, min(misfit) AS misfit FROM f GROUP BY 1 -- misfit""")
def mode_pair_fit(spark, sf_dir):
    """Toroidal and poloidal mode number of each cluster together."""
    vectors = features.mean_mode_vector(feature_rows(spark, sf_dir).select("instance_id", "cluster", "amp"))
    places = vectors.select("ch_ix").distinct().select("ch_ix", (F.col("ch_ix") * 0.9).alias("phi"), (F.col("ch_ix") * F.col("ch_ix") * 0.17).alias("theta"))
    return features.mode_pairs(vectors, places, 5, 8)


LINE_COILS = ", ".join(f"({i}, {th}::DOUBLE, {ph}::DOUBLE)" for i, (th, ph) in enumerate(zip(geometry.COIL_THETA[1:], geometry.COIL_PHI[1:], strict=True)))


@query(f"""WITH m AS (SELECT DISTINCT -(s_suppkey % 7)::INT AS n, (s_suppkey % 5)::INT AS m FROM supplier), c AS (SELECT * FROM (VALUES {LINE_COILS}) v(place, theta, phi)), p AS (SELECT n, m, place, radians(m * theta + n * phi) AS p FROM m, c), d AS (SELECT *, p - lag(p) OVER (PARTITION BY n, m ORDER BY place) AS d FROM p),
w AS (SELECT *, CASE WHEN d < -1.5 * pi() THEN d + 2 * pi() WHEN d > 0.5 * pi() THEN d - 2 * pi() ELSE d END AS x FROM d) SELECT n, m, place, coalesce(sum(x) OVER (PARTITION BY n, m ORDER BY place), 0) / (2 * pi()) AS turns FROM w -- turns""", digits=6)
def rep_mode_lines(spark, sf_dir):
    """Lines of the modes that the suppliers' numbers name."""
    modes = table(spark, sf_dir, "supplier").select((-(F.col("s_suppkey") % 7)).cast("int").alias("n"), (F.col("s_suppkey") % 5).cast("int").alias("m")).distinct()
    return reports.rep_mode_lines(spark, modes)


@query("SELECT count(*) AS n FROM embeddings")
def generate_artificial_data(spark, sf_dir):
    """As many features as there are vectors."""
    n = table(spark, sf_dir, "embeddings").count()
    return clustering.artificial(spark, n, 4, 3, seed=1).agg(F.count(F.lit(1)).alias("n"))


@query()
def rep_vm_sweep(spark, sf_dir):
    """Samples as large as the table of events; each true concentration beside its estimates."""
    return reports.rep_vm_sweep(spark, n=table(spark, sf_dir, "events").count(), step=3)


@query()
def mine(spark, sf_dir):
    """The batch flow over the hourly event channels of four shots, with the default settings but for the length of the windows and the band."""
    from tideline.plans.mine import Settings
    from tideline.plans.mine import mine as run

    smp = files.written(event_grid(spark, sf_dir, 1, by_shot=True))
    rows, found = run(smp, Settings(freq_range="0-1", nfft=64, step=16))
    return rows.join(found.assignments, "instance_id").groupBy("shot", "cluster").agg(F.count(F.lit(1)).alias("n"))


EVENT_NUMBERS = f"{EVENTS}, n AS (SELECT shot, ch_ix, row_number() OVER (PARTITION BY shot, ch_ix ORDER BY event_id) - 1 AS sample_ix, floor(value * 10) - 2500 AS value FROM ev)"


def numbered_events(spark, sf_dir):
    """Events of each shot and type as 16-bit samples, in order."""
    whole = (F.floor(F.col("value") * 10) - 2500).cast("double")
    rows = blocks.numbered(event_samples(spark, sf_dir).select("shot", "ch_ix", "event_id", whole.alias("value")), "event_id", name="sample_ix", keys=("shot", "ch_ix"))
    return rows.select(F.lit("EV").alias("diag"), "shot", F.col("ch_ix").cast("long").alias("channel"), "sample_ix", "value")


@query(f"WITH {EVENT_NUMBERS} SELECT 'EV' AS diag, shot, ch_ix AS channel, sample_ix, sample_ix / 4.0 AS t, value FROM n -- t value")
def src_lhd_bin(spark, sf_dir):
    """Written as recorder files and read back by the data source."""
    readers.register(spark)
    path = files.shared_folder(spark)
    rows = numbered_events(spark, sf_dir).repartition("shot", "channel").sortWithinPartitions("shot", "channel", "sample_ix")
    rows.write.format("recorder").option("rate", 4.0).mode("append").save(path)
    return spark.read.format("recorder").load(path)


@query(f"WITH {EVENT_NUMBERS} SELECT shot, 'CH' || ch_ix AS channel, sample_ix, sample_ix * 0.5 AS t, value / 10 AS value FROM n -- t value")
def src_lhd_npz(spark, sf_dir):
    """Written as archives and read back by the data source."""
    readers.register(spark)
    path = files.shared_folder(spark)
    rows = numbered_events(spark, sf_dir).select("shot", F.concat(F.lit("CH"), F.col("channel")).alias("channel"), "sample_ix", (F.col("sample_ix") * 0.5).alias("t"), (F.col("value") / 10).alias("value"))
    rows.repartition("shot", "channel").sortWithinPartitions("shot", "channel", "sample_ix").write.format("signal_archive").mode("append").save(path)
    return spark.read.format("signal_archive").load(path)


@query(f"WITH {EVENT_NUMBERS} SELECT shot, sample_ix, sample_ix / 4.0 AS t, value FROM n WHERE ch_ix = 2 AND shot IN (1, 3) -- t value")
def src_fetch_lifecycle(spark, sf_dir):
    """One channel of two shots, fetched by the names of its files."""
    path = files.shared_folder(spark)
    readers.register(spark)
    rows = numbered_events(spark, sf_dir).repartition("shot", "channel").sortWithinPartitions("shot", "channel", "sample_ix")
    rows.write.format("recorder").option("rate", 4.0).mode("append").save(path)
    return readers.fetch(spark, path, [1, 3], "EV", 2).select("shot", "sample_ix", "t", "value")
