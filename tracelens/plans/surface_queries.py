"""Queries of smaller operators, of files and of what users can extend, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import folder
from ..operators import measures as M
from ..operators import normalize as N
from ..operators import richness as R
from ..operators import sampling as P
from ..operators import tables as T
from ..operators.metrics import column_of, select_metrics
from ..sources import results
from . import jobs
from .queries import BASIC_SQL, DEVIATION_SQL, FREQ, KINDS, LEMPEL_ZIV, PREFIX, SAMPLES, VAR, WIN, _draw_sql, _master_sql, _raw, _raw_sql, _species, ev_traces, ev_windows, query, six, table

REC = VAR.replace("ev as (select", "recursive ev as (select", 1)
TREE = PREFIX.replace(" S,", " sa,").replace(" M,", " ma,").replace(" K from", " ka from")
AFFINITY = """sets as (select window_id, list_sort(list_distinct(acts)) as s, sum(n) as n from vr group by 1, 2),
 af1 as (select x.window_id, sum(2 * x.n * y.n * len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))) as c from sets x join sets y on x.window_id = y.window_id and x.s < y.s group by 1),
 af as (select window_id, case when t > 1 then (same + coalesce(c, 0)) / (t * (t - 1)) end as affinity from (select window_id, sum(n) as t, sum(n * (n - 1)) as same from sets group by 1) left join af1 using (window_id))"""
EDITS = """lt as (select activity as x, chr(64 + cast(row_number() over (order by activity) as int)) as ch from (select distinct activity from ev)),
 ex as (select window_id, acts, n, unnest(acts) as x, unnest(range(0, len)) as i from vr), cd as (select window_id, acts, max(n) as n, string_agg(ch, '' order by i) as code from ex join lt using (x) group by 1, 2),
 ed1 as (select x.window_id, sum(x.n * y.n * levenshtein(x.code, y.code)) as d from cd x join cd y on x.window_id = y.window_id and x.code < y.code group by 1),
 ed as (select window_id, case when t > 1 then coalesce(d, 0) / (t * (t - 1) / 2) end as edit from (select window_id, sum(n) as t from vr group by 1) left join ed1 using (window_id))"""


@query(f"""with {REC}, {BASIC_SQL}, {TREE}, {DEVIATION_SQL}, {LEMPEL_ZIV}, {AFFINITY}, {EDITS}
 select window_id, cast(number_of_events as bigint) as number_of_events, cast(number_of_traces as bigint) as number_of_traces, bm.v as number_of_distinct_activities, dt as number_of_distinct_traces, bm.e as number_of_distinct_directly_follows_relations,
 cast(lo as double) as min_trace_length, round(number_of_events / number_of_traces, 6) as avg_trace_length, cast(hi as double) as max_trace_length, round(dt / number_of_traces, 6) as percentage_of_distinct_traces, round(avg_act, 6) as average_distinct_activities_per_trace,
 round(1 - bm.e / power(bm.v, 2), 6) as structure, round(power(10, 0.08e0 * (1 + bm.e - bm.v)), 6) as estimated_number_of_acyclic_paths, cast(ties as double) as number_of_ties_in_paths_to_goal, cast(lz as double) as lempel_ziv_complexity,
 round(affinity, 6) as average_affinity, round(dv.d, 6) as deviation_from_random, round(edit, 6) as average_edit_distance, round(ma * ln(ma) - lm, 6) as sequence_entropy, round((ma * ln(ma) - lm) / (ma * ln(ma)), 6) as normalized_sequence_entropy,
 round(sa * ln(sa) - ls, 6) as variant_entropy, round((sa * ln(sa) - ls) / (sa * ln(sa)), 6) as normalized_variant_entropy
 from bm join sm using (window_id) join dv using (window_id) join lc using (window_id) join af using (window_id) join ed using (window_id)""")
def all_measures_sliding(spark, d):
    return six(M.all_measures(ev_windows(spark, d)))


@query(f"""with {FREQ}, z as (select *, unnest(range(1, n)) as m from c1 where 1 - f1 / n * a >= 0.9),
 cz as (select z.log, z.species_kind, m, 1 - sum(case when z.n - sc.n >= m then sc.n / z.n * exp(lgamma(z.n - sc.n + 1) - lgamma(z.n - sc.n - m + 1) - lgamma(z.n) + lgamma(z.n - m)) else 0 end) as c from z join sc using (log, species_kind) group by 1, 2, 3),
 lo as (select log, species_kind, min(m) as m from cz where c >= 0.9 group by 1, 2)
 select log, species_kind, cast(case when 1 - f1 / n * a >= 0.9 then coalesce(m, n) when a > 0 and a < 1 then n + greatest(1, ceil(ln(0.1e0 / (f1 / n)) / ln(a) - 1)) end as bigint) as effort, round(1 - f1 / n * a, 6) as coverage from c1 left join lo using (log, species_kind)""")
def effort_for_coverage(spark, d):
    return six(R.effort_for_coverage(_species(spark, d), KINDS, 0.9))


@query(f"""with {VAR}, {BASIC_SQL} select window_id, cast(number_of_events as bigint) as number_of_events, e as number_of_distinct_directly_follows_relations, round(1 - e / power(v, 2), 6) as structure from bm""")
def filtered_measures(spark, d):
    """Measures by name or short name, each once."""
    wanted = [column_of(n) for n in select_metrics(["events", "transitions", "Structure", "structure"])]
    return six(M.all_measures(ev_windows(spark, d), wanted=wanted))


@query(f"""with {VAR.split(', ks as')[0]}, gr as (select k as sample_no, 20 as sample_size from range(0, 3) x(k)), st as (select *, {_draw_sql('123', 'sample_no', 'sample_size')} % ((select count(*) from ti) - sample_size + 1) as f from gr)
 select cast(sample_size as bigint) as sample_size, cast(sample_no as varchar) as sample_id, case_id from st join ti on trace_index >= f and trace_index < f + sample_size""")
def sample_edge_sizes(spark, d):
    """Sizes that are not positive have no samples, nor has a number of samples of none."""
    rows = ev_traces(spark, d)
    some = P.sample_consecutive(rows, [20, 0, -5], 3).unionByName(P.sample_random(rows, [20], 0)).unionByName(P.sample_random(rows, [0], 3, "none"))
    return six(some.select("sample_size", "sample_id", "case_id"))


@query(f"""with {REC}, {BASIC_SQL}, {LEMPEL_ZIV} select window_id, cast(lz as double) as value, round(lz / (number_of_events / (ln(number_of_events) / ln(v))), 6) as value_normalized from bm join lc using (window_id)""")
def normalized_lempel_ziv(spark, d):
    rows = N.normalize(M.all_measures(ev_windows(spark, d), wanted=["number_of_events", "number_of_distinct_activities", "lempel_ziv_complexity"]), ["window_id"])
    return six(rows.where("metric = 'lempel_ziv_complexity'").select("window_id", "value", "value_normalized"))


@query(f"""with {_raw_sql('raw')}, {_master_sql('ma', 'raw')}, al as (select metric, log, basis, dimension from ma union all select distinct metric, 'MEAN', basis, dimension from ma)
 select metric, log, row_number() over (order by list_position(['OC', 'PC', 'PD', 'CT'], basis), list_position(['Length', 'Size', 'Variation', 'Distance', 'Graph Entropy'], dimension),
 list_position(['number_of_events', 'number_of_traces', 'number_of_distinct_activities', 'number_of_distinct_traces', 'number_of_distinct_directly_follows_relations', 'min_trace_length', 'avg_trace_length'], metric), log = 'MEAN', log) - 1 as place from al""")
def ordered_master(spark, d):
    """Places of the rows of a master table with its means: measures times logs, so one partition is enough."""
    rows = T.ordered(T.with_means(T.master(T.analysis(_raw(spark, d)))))
    return rows.select("metric", "log").coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query(f"""with {WIN} select 'EV' as dataset, 'plain' as config, window_id, min(trace_index) as first_index, max(trace_index) as last_index from mem group by window_id""")
def complexity_table_parts(spark, d):
    """Window rows written by dataset and configuration, and read again."""
    path = folder(spark)
    rows = ev_windows(spark, d).groupBy("window_id").agg(F.min("trace_index").alias("first_index"), F.max("trace_index").alias("last_index"))
    results.write_complexity(rows.withColumns({"dataset": F.lit("EV"), "config": F.lit("plain")}), path)
    return spark.read.parquet(path).select("dataset", "config", "window_id", "first_index", "last_index")


@query("""select n_name as dataset, 'nation ' || n_nationkey as name, upper(substr(n_name, 1, 3)) as short_name, 'real' as type, 'logs/' || n_nationkey as path from nation where n_regionkey % 2 = 0""")
def catalogue_of_logs(spark, d):
    """A catalogue file of nations, read by type."""
    n, path = table(spark, d, "nation"), folder(spark)
    key = F.col("n_nationkey").cast("string")
    entry = F.struct(F.concat(F.lit("nation "), key).alias("name"), F.upper(F.substring("n_name", 1, 3)).alias("short_name"), F.when(F.col("n_regionkey") % 2 == 0, "real").otherwise("synthetic").alias("type"), F.concat(F.lit("logs/"), key).alias("path"))
    n.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", entry)))).alias("value")).coalesce(1).write.text(path)  # 25 nations
    return results.catalogue(spark, path, ["real"])


@query("""with n as (select count(*) as n from orders), k as (select unnest(['one_variant', 'rare', 'two_lengths']) as kind)
 select kind, n as number_of_traces, case kind when 'one_variant' then 5 * n when 'rare' then 2 * n else 5 * (n - n // 2) + 10 * (n // 2) end as number_of_events,
 cast(case kind when 'one_variant' then 1 when 'rare' then 11 else 2 end as bigint) as number_of_distinct_traces, cast(case kind when 'one_variant' then 5 when 'rare' then 12 else 10 end as bigint) as number_of_distinct_activities from n, k""")
def synthetic_logs(spark, d):
    """Made-up logs with as many traces as there are orders."""
    n = table(spark, d, "orders").count()
    parts = [jobs.synthetic_log(spark, k, n).withColumn("kind", F.lit(k)) for k in ("one_variant", "rare", "two_lengths")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("pos", F.col("trace_index"))
    return six(M.basic(rows, ["kind"]).select("kind", "number_of_traces", "number_of_events", "number_of_distinct_traces", "number_of_distinct_activities"))


#: Chao1 populations of variants, by window.
VARIANTS = """fq as (select window_id, sum(n) as n, count(*) filter (n = 1) as f1, count(*) filter (n = 2) as f2, count(*) as so from vr group by 1),
 ch as (select window_id, so + ceil(case when f1 = 0 then 0 when f2 > 0 then (n - 1) / n * f1 * f1 / (2 * f2) else (n - 1) / n * f1 * (f1 - 1) / 2 end) as pop from fq)"""


@query(f"""with {VAR}, {BASIC_SQL}, {VARIANTS}, sh as (select bm.*, pop / number_of_traces as s from bm join ch using (window_id)),
 r as (select 'base' as scenario, window_id, 'number_of_events' as metric, cast(number_of_events as double) as value from sh union all select 'base', window_id, 'percentage_of_distinct_traces', dt / number_of_traces from sh
 union all select 'normalized', window_id, 'number_of_events', number_of_events / number_of_traces from sh union all select 'normalized', window_id, 'percentage_of_distinct_traces', greatest(0, least(number_of_traces, dt / number_of_traces * number_of_traces)) from sh
 union all select 'normalized_population', window_id, 'number_of_events', number_of_events / number_of_traces from sh union all select 'normalized_population', window_id, 'percentage_of_distinct_traces', greatest(0, least(number_of_traces, case when s > 1 then s / 100 else s end * number_of_traces)) from sh)
 select scenario, window_id, metric, round(value, 6) as value from r""")
def ladder_of_fixes(spark, d):
    """The same windows plain, normalized, and normalized with estimated populations."""
    from dataclasses import replace

    members, out = ev_windows(spark, d), None
    for s in jobs.LADDER:
        part = jobs.measure(members, ["window_id"], replace(s, wanted=["number_of_events", "percentage_of_distinct_traces"])).withColumn("scenario", F.lit(s.name))
        out = part if out is None else out.unionByName(part)
    return six(out.select("scenario", "window_id", "metric", "value"))


@query(f"""with {VAR}, {BASIC_SQL}, lg as (select window_id, max(len) - min(len) as spread from vr group by 1),
 r as (select window_id, 'number_of_events' as metric, round(number_of_events / 1000, 6) as value from bm union all select window_id, 'number_of_distinct_traces', 2 * dt from bm union all select window_id, 'length_spread', cast(spread as double) from lg)
 select * from r""")
def own_extensions(spark, d):
    """A measure, a normalizer and a population of one's own, used by name beside the built-in ones."""
    spread = ("length_spread", lambda members, keys: members.groupBy(*keys).agg((F.max("len") - F.min("len")).cast("double").alias("length_spread")))
    doubled = lambda counts, keys: counts.groupBy(*keys).agg((2 * F.count(F.lit(1))).alias("population_count"))
    own = jobs.Scenario("own", doubled, True, wanted=["number_of_events", "number_of_distinct_traces"], normalizers={"number_of_events": lambda c: c("number_of_events") / 1000}, custom=[spread])
    return six(jobs.measure(ev_windows(spark, d), ["window_id"], own).select("window_id", "metric", "value"))
