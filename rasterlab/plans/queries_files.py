"""File-name analytics on the file-list views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.operators import filenames as fn
from rasterlab.plans import views
from rasterlab.plans.registry import query, rounded
from rasterlab.sources import files as fs

PATHS = """
 paths AS (SELECT DISTINCT '/data/exp/' || CASE WHEN l_suppkey % 10 = 9 THEN '.cache' ELSE l_returnflag END || '/' ||
           CASE WHEN l_partkey % 7 = 3 THEN '.' ELSE '' END || 'img' || CAST(l_suppkey AS VARCHAR) || '_w' || CAST(l_linenumber AS VARCHAR) ||
           CASE l_partkey % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '.png' ELSE '.tiff' END AS path FROM lineitem)"""


def paths(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select(F.expr("""concat('/data/exp/',
        case when l_suppkey % 10 = 9 then '.cache' else l_returnflag end, '/', case when l_partkey % 7 = 3 then '.' else '' end,
        'img', cast(l_suppkey as string), '_w', cast(l_linenumber as string),
        case l_partkey % 4 when 0 then '.tif' when 1 then '.TIFF' when 2 then '.png' else '.tiff' end)""").alias("path")).distinct()


@query("s1_experiment_scan", "", f"""{PATHS}
SELECT split_part(path, '/', 4) AS condition, split_part(path, '/', 5) AS name, path FROM paths
WHERE regexp_matches(lower(path), '\\.tiff?$') AND split_part(path, '/', 4) NOT LIKE '.%' AND split_part(path, '/', 5) NOT LIKE '.%'""")
def s1_experiment_scan(spark, sf_dir):
    return fs.experiment_files(paths(spark, sf_dir))


SUFFIX = """
 n AS (SELECT DISTINCT l_returnflag AS condition, 's' || CAST(l_suppkey % 20 AS VARCHAR) || '_' ||
       CASE l_linenumber % 4 WHEN 0 THEN 'c0' WHEN 1 THEN 'C1' WHEN 2 THEN 'C2_extra' || CAST(l_partkey % 3 AS VARCHAR) ELSE 'X9' END ||
       CASE l_partkey % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.PNG' ELSE '.jpg' END AS name FROM lineitem)"""


@query("s2_group_by_suffix", "", f"""{SUFFIX}
SELECT condition, regexp_extract(name, '^(.+?)_(C0|C1|C2)(?:_.*)?\\.(?:tif|tiff|png)$', 1, 'i') AS base,
       upper(regexp_extract(name, '^(.+?)_(C0|C1|C2)(?:_.*)?\\.(?:tif|tiff|png)$', 2, 'i')) AS suffix, max(name) AS name
FROM n WHERE regexp_matches(name, '^(.+?)_(C0|C1|C2)(?:_.*)?\\.(?:tif|tiff|png)$', 'i') GROUP BY ALL""")
def s2_group_by_suffix(spark, sf_dir):
    names = views.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as condition", """concat('s', cast(l_suppkey % 20 as string), '_',
        case l_linenumber % 4 when 0 then 'c0' when 1 then 'C1' when 2 then concat('C2_extra', cast(l_partkey % 3 as string)) else 'X9' end,
        case l_partkey % 3 when 0 then '.tif' when 1 then '.PNG' else '.jpg' end) as name""").distinct()
    return fn.group_by_suffix(names, ["C0", "C1", "C2"])


LEG = """
 n AS (SELECT DISTINCT CASE l_partkey % 6 WHEN 0 THEN 'smp' || l_suppkey % 9 || '_w' || l_linenumber || '_t00_z00.tif'
        WHEN 1 THEN 'cap_XY' || l_suppkey || '_Z0_T0_C' || l_linenumber || '.tiff' WHEN 2 THEN 'Hac SA_C0' || l_linenumber || '_sx_1_sy_2_w2.tif'
        WHEN 3 THEN 'base' || l_suppkey % 9 || '_DAPI.TIF' WHEN 4 THEN 'odd_name ' || l_linenumber || '.tif' ELSE 'single' || l_linenumber || '.tif' END AS name FROM lineitem)"""
P1 = "'^(.+?)_([A-Za-z][0-9]+(?:_[a-z][0-9]+)*)\\.tif(?:f)?$'"
P2 = "'^(.+?)_XY[0-9]+.*?_([A-Za-z][0-9]+)\\.tif(?:f)?$'"
P3 = "'^(.+?)_([A-Za-z][0-9]+)_sx_[0-9]+_sy_[0-9]+.*?\\.tif(?:f)?$'"
P4 = "'^(.+?)_([^_\\s]+)\\.tif(?:f)?$'"


def _case(group: int) -> str:
    arms = " ".join(f"WHEN regexp_matches(name, {p}, 'i') THEN trim(regexp_extract(name, {p}, {group}, 'i'))" for p in (P1, P2, P3, P4))
    last = f"trim(regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), '^(.*)_([^_]*)$', {group}))"
    return f"CASE {arms} WHEN contains(regexp_replace(name, '\\.[^.]*$', ''), '_') THEN {last} END"


@query("s3_legacy_grouping", "", f"{LEG} SELECT name, {_case(1)} AS base, {_case(2)} AS suffix FROM n")
def s3_legacy_grouping(spark, sf_dir):
    names = views.table(spark, sf_dir, "lineitem").select(F.expr("""case l_partkey % 6
        when 0 then concat('smp', l_suppkey % 9, '_w', l_linenumber, '_t00_z00.tif') when 1 then concat('cap_XY', l_suppkey, '_Z0_T0_C', l_linenumber, '.tiff')
        when 2 then concat('Hac SA_C0', l_linenumber, '_sx_1_sy_2_w2.tif') when 3 then concat('base', l_suppkey % 9, '_DAPI.TIF')
        when 4 then concat('odd_name ', l_linenumber, '.tif') else concat('single', l_linenumber, '.tif') end""").alias("name")).distinct()
    return fn.legacy_grouping(names)


MASKS = """
 paths AS (SELECT DISTINCT '/out/masks/' || l_returnflag || '/img' || CAST(l_suppkey AS VARCHAR) || CASE WHEN l_linenumber = 1 THEN '_cellular' ELSE '' END ||
           CASE l_partkey % 4 WHEN 0 THEN '_masks.tif' WHEN 1 THEN '_masks_v2.tif' WHEN 2 THEN '_masks.npy' ELSE '_raw.tif' END AS path FROM lineitem),
 saved AS (SELECT split_part(path, '/', 4) AS condition, replace(replace(regexp_replace(split_part(path, '/', 5), '\\.[^.]*$', ''), '_masks', ''), '_cellular', '') AS base, path
           FROM paths WHERE regexp_matches(path, '_masks[^/]*\\.tif$') OR regexp_matches(path, '_masks\\.npy$'))"""


def mask_paths(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select(F.expr("""concat('/out/masks/', l_returnflag, '/img',
        cast(l_suppkey as string), case when l_linenumber = 1 then '_cellular' else '' end,
        case l_partkey % 4 when 0 then '_masks.tif' when 1 then '_masks_v2.tif' when 2 then '_masks.npy' else '_raw.tif' end)""").alias("path")).distinct()


@query("s7_saved_masks", "", f"{MASKS} SELECT condition, base, path FROM saved")
def s7_saved_masks(spark, sf_dir):
    return fs.saved_masks(mask_paths(spark, sf_dir))


@query("s14_skip_existing", "raster", """
 done AS (SELECT DISTINCT 'c' || CAST((o_orderkey // 2500) % 3 AS VARCHAR) AS condition, o_orderkey // 2500 AS image_set FROM orders WHERE (o_orderkey // 2500) % 2 = 1)
SELECT DISTINCT condition, image_set FROM raster ANTI JOIN done USING (condition, image_set)""")
def s14_skip_existing(spark, sf_dir):
    images = views.raster(spark, sf_dir).select("condition", "image_set").distinct()
    return fs.pending(images, images.where("image_set % 2 = 1"))


@query("s15_mask_completeness", "", f"""{MASKS},
 cat AS (SELECT DISTINCT l_returnflag AS condition, 'img' || CAST(l_suppkey AS VARCHAR) AS base FROM lineitem),
 h AS (SELECT DISTINCT condition, base, true AS m FROM saved)
SELECT condition, count(base) AS expected, count(m) AS found, count(m) >= count(base) AND count(base) > 0 AS is_complete
FROM cat LEFT JOIN h USING (condition, base) GROUP BY ROLLUP (condition)""")
def s15_mask_completeness(spark, sf_dir):
    cat = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag as condition", "concat('img', cast(l_suppkey as string)) as base")
    return fs.mask_completeness(cat, fs.saved_masks(mask_paths(spark, sf_dir)))


TOK = """
 tok AS (SELECT condition, name, [trim(t) FOR t IN string_split_regex(regexp_replace(name, '\\.tiff?$', '', 'i'), '[_-]') IF trim(t) <> ''] AS tokens FROM gappy_files),
 sz AS (SELECT *, CAST(len(tokens) AS INT) AS n_tokens FROM tok),
 dom AS (SELECT condition, n_tokens AS n_positions FROM (SELECT condition, n_tokens, count(*) AS c, min(name) AS f FROM sz WHERE n_tokens >= 2 GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY condition ORDER BY c DESC, f) = 1),
 grp AS (SELECT sz.*, n_positions, coalesce(n_tokens <> n_positions, true) AS is_orphan FROM sz LEFT JOIN dom USING (condition)),
 pt AS (SELECT condition, n_positions, CAST(pos AS INT) AS pos, token, count(*) AS files
        FROM (SELECT condition, n_positions, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM grp WHERE NOT is_orphan) GROUP BY ALL),
 ff AS (SELECT condition, n_positions, pos, files AS freq, count(*) AS times, sum(files) AS fs FROM pt GROUP BY ALL),
 ps AS (SELECT condition, n_positions, pos, CAST(sum(times) AS BIGINT) AS cardinality, arg_min(freq, -times * 1000000 + freq) AS dominant_freq, CAST(sum(fs) AS BIGINT) AS total_files FROM ff GROUP BY ALL)"""
LIKE = """CASE WHEN list_contains(['dapi','hoechst','nuclear','nuc','gfp','egfp','fitc','alexa488','488','rfp','mrfp','mcherry','cherry','tritc','cy3','alexa555','555','561','cy5','alexa647','647','bf','brightfield','dic','phase','tl','cfp','yfp','bfp'], lower(trim(token))) THEN 1.0
  WHEN len(string_split_regex(lower(trim(token)), '\\s+')) > 1 AND list_has_any(string_split_regex(lower(trim(token)), '\\s+'), ['dapi','hoechst','nuclear','nuc','gfp','egfp','fitc','alexa488','488','rfp','mrfp','mcherry','cherry','tritc','cy3','alexa555','555','561','cy5','alexa647','647','bf','brightfield','dic','phase','tl','cfp','yfp','bfp']) THEN 0.95
  WHEN regexp_full_match(split_part(lower(trim(token)), ' ', 1), '(w|c|ch)[0-9]') THEN 0.95 WHEN regexp_full_match(split_part(lower(trim(token)), ' ', 1), '(w|c|ch)[0-9]{2}') THEN 0.85
  WHEN regexp_full_match(split_part(lower(trim(token)), ' ', 1), '[a-z][0-9]') THEN 0.6 WHEN regexp_full_match(split_part(lower(trim(token)), ' ', 1), '[a-h][0-9]{2,3}') THEN 0.1
  WHEN regexp_full_match(split_part(lower(trim(token)), ' ', 1), '[0-9]{3}') AND TRY_CAST(split_part(lower(trim(token)), ' ', 1) AS INT) BETWEEN 350 AND 800 THEN 0.8
  WHEN regexp_full_match(split_part(lower(trim(token)), ' ', 1), '[0-9]{1,2}') THEN 0.05 ELSE 0 END::DOUBLE"""
SCORE = f"""{TOK},
 li AS (SELECT condition, pos, avg(lk) AS likeness, bool_and(regexp_full_match(token, '[0-9]+') AND lk < 0.5) AS ad FROM (SELECT *, {LIKE} AS lk FROM pt) GROUP BY ALL),
 sc AS (SELECT ps.*, likeness, CASE WHEN cardinality < 2 THEN -1 ELSE CASE WHEN cardinality > 10 THEN -5 ELSE 0 END
     + CASE WHEN cardinality * dominant_freq / total_files > 0.8 THEN 10 * cardinality * dominant_freq / total_files WHEN cardinality * dominant_freq / total_files > 0.5 THEN 5 * cardinality * dominant_freq / total_files ELSE -5 END
     + 20 * likeness + CASE WHEN cardinality <= 6 THEN 3 WHEN cardinality <= 10 THEN 1 ELSE 0 END
     + CASE WHEN n_positions > 1 THEN pos / (n_positions - 1) * 2 ELSE 0 END - CASE WHEN ad THEN 8 ELSE 0 END END AS score FROM ps JOIN li USING (condition, pos)),
 best AS (SELECT condition, max(score) AS score, CAST(CASE WHEN max(score) < 0 THEN any_value(n_positions) - 1 ELSE arg_max(pos, score * 1000 - pos / 1e6) END AS INT) AS channel_pos FROM sc GROUP BY ALL),
 sets AS (SELECT condition, name, array_to_string(list_concat(tokens[1:channel_pos], tokens[channel_pos+2:]), '_') AS base, tokens[channel_pos+1] AS suffix
          FROM grp JOIN best USING (condition) WHERE NOT is_orphan)"""


def grouped(spark, sf_dir):
    return fn.dominant_group(fn.tokenise(views.gappy_files(spark, sf_dir)))


def scored(spark, sf_dir):
    return fn.score_positions(fn.position_tokens(grouped(spark, sf_dir)))


def sets(spark, sf_dir):
    return fn.build_image_sets(grouped(spark, sf_dir), fn.channel_position(scored(spark, sf_dir)))


@query("f1_tokenise", "gappy_files", f"{TOK} SELECT condition, name, array_to_string(tokens, '|') AS tokens FROM tok")
def f1_tokenise(spark, sf_dir):
    return fn.tokenise(views.gappy_files(spark, sf_dir)).withColumn("tokens", F.array_join("tokens", "|"))


@query("f2_dominant_group", "gappy_files", f"{TOK} SELECT condition, name, n_tokens, n_positions, is_orphan FROM grp")
def f2_dominant_group(spark, sf_dir):
    return grouped(spark, sf_dir).drop("tokens")


@query("f3_position_stats", "gappy_files", f"{TOK} SELECT condition, n_positions, pos, cardinality, dominant_freq, total_files FROM ps")
def f3_position_stats(spark, sf_dir):
    return fn.position_stats(fn.position_tokens(grouped(spark, sf_dir)))


@query("f4_channel_likeness", "", f"""
 words AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || CASE p_partkey % 8 WHEN 0 THEN 'GFP' WHEN 1 THEN 'w' || p_size % 10 WHEN 2 THEN 'C' || (10 + p_size) WHEN 3 THEN 'A' || (100 + p_size)
           WHEN 4 THEN CAST(300 + p_partkey % 700 AS VARCHAR) WHEN 5 THEN CAST(p_size AS VARCHAR) WHEN 6 THEN 'k' || p_size % 10 ELSE 'Dapi' END, ' ')) AS token FROM part
   UNION SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'DAPI ' WHEN 1 THEN 'w1 ' ELSE 'my ' END || p_brand FROM part)
SELECT token, {LIKE} AS likeness FROM words""")
def f4_channel_likeness(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split(F.expr("""concat(p_name, ' ', case p_partkey % 8 when 0 then 'GFP' when 1 then concat('w', p_size % 10)
        when 2 then concat('C', 10 + p_size) when 3 then concat('A', 100 + p_size) when 4 then cast(300 + p_partkey % 700 as string)
        when 5 then cast(p_size as string) when 6 then concat('k', p_size % 10) else 'Dapi' end)"""), " ")).alias("token"))
    more = part.select(F.expr("concat(case p_partkey % 3 when 0 then 'DAPI ' when 1 then 'w1 ' else 'my ' end, p_brand)").alias("token"))
    return words.union(more).distinct().withColumn("likeness", fn.channel_likeness(F.col("token")))


@query("f5_position_scores", "gappy_files", f"{SCORE} SELECT condition, pos, cardinality, round(likeness, 6) AS likeness, round(score, 6) AS score FROM sc")
def f5_position_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("condition", "pos", "cardinality", "likeness", "score"))


@query("f6_image_sets", "gappy_files", f"{SCORE} SELECT condition, name, base, suffix FROM sets")
def f6_image_sets(spark, sf_dir):
    return sets(spark, sf_dir)


@query("f7_completeness", "gappy_files", f"""{SCORE},
 pl AS (SELECT DISTINCT condition, base, suffix FROM sets), ns AS (SELECT condition, count(DISTINCT suffix) AS n_channels FROM pl GROUP BY ALL),
 st AS (SELECT condition, base, count(*) AS have FROM pl GROUP BY ALL),
 a AS (SELECT condition, any_value(n_channels) AS n_channels, count(*) AS n_image_sets, count(*) FILTER (have = n_channels) AS n_complete,
              count(*) FILTER (have <> n_channels) AS n_incomplete, sum(have) AS places FROM st JOIN ns USING (condition) GROUP BY ALL),
 f AS (SELECT condition, count(*) AS n_files FROM gappy_files GROUP BY ALL), g AS (SELECT condition, count(*) AS gr FROM sets GROUP BY ALL)
SELECT condition, n_files, n_channels, n_image_sets, n_complete, n_incomplete, n_files - gr AS n_orphans, round(places / n_files, 6) AS confidence
FROM f JOIN a USING (condition) JOIN g USING (condition)""")
def f7_completeness(spark, sf_dir):
    return rounded(fn.completeness(views.gappy_files(spark, sf_dir), sets(spark, sf_dir)))


@query("u2_missing_channels", "gappy_files", f"""{SCORE},
 ex AS (SELECT DISTINCT condition, suffix FROM sets), ba AS (SELECT DISTINCT condition, base FROM sets)
SELECT condition, base, suffix FROM ba JOIN ex USING (condition) ANTI JOIN sets USING (condition, base, suffix)""")
def u2_missing_channels(spark, sf_dir):
    from rasterlab.operators.tables import missing_channels

    s = sets(spark, sf_dir)
    return missing_channels(s, s.select("condition", "suffix").distinct()).select("condition", "base", "suffix")


@query("f7_missing_suffixes", "gappy_files", f"""{SCORE},
 ex AS (SELECT DISTINCT condition, suffix FROM sets), ba AS (SELECT DISTINCT condition, base FROM sets)
SELECT condition, base, string_agg(suffix, ',' ORDER BY suffix) AS missing FROM ba JOIN ex USING (condition) ANTI JOIN sets USING (condition, base, suffix) GROUP BY ALL""")
def f7_missing_suffixes(spark, sf_dir):
    return fn.missing_suffixes(sets(spark, sf_dir)).withColumn("missing", F.array_join("missing", ","))


@query("f8_channel_roles", "", """
 s AS (SELECT DISTINCT l_returnflag AS condition, CASE WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'DAPI' WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN 'Actin' ELSE 'C' || (11 - l_linenumber) END AS suffix FROM lineitem),
 k AS (SELECT *, CASE WHEN lower(suffix) IN ('dapi','hoechst','nuclear','nuc') THEN 'nuclear' WHEN lower(suffix) IN ('phalloidin','actin','cyto','cytoplasm') THEN 'cyto' END AS named,
              coalesce(TRY_CAST(regexp_extract(suffix, '([0-9]+)', 1) AS INT), 999) AS natural_key FROM s),
 o AS (SELECT *, row_number() OVER (PARTITION BY condition, named IS NULL ORDER BY natural_key, suffix) AS rn,
              bool_or(coalesce(named = 'nuclear', false)) OVER (PARTITION BY condition) AS hn, bool_or(coalesce(named = 'cyto', false)) OVER (PARTITION BY condition) AS hc FROM k)
SELECT condition, suffix, natural_key, CASE WHEN named IS NOT NULL THEN named WHEN NOT hn AND rn = 1 THEN 'nuclear' WHEN NOT hc AND rn = CASE WHEN hn THEN 1 ELSE 2 END THEN 'cyto' ELSE 'marker' END AS role FROM o""")
def f8_channel_roles(spark, sf_dir):
    suffixes = views.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("condition"), F.expr("""
        case when l_returnflag = 'A' and l_linenumber = 2 then 'DAPI' when l_returnflag = 'N' and l_linenumber = 3 then 'Actin'
             else concat('C', 11 - l_linenumber) end""").alias("suffix")).distinct()
    return fn.suggest_roles(suffixes)


BAND = """CASE WHEN nm <= 0 THEN '#FFFFFF' WHEN nm < 450 THEN '#7B2FBE' WHEN nm < 500 THEN '#4488FF' WHEN nm < 560 THEN '#00CC44'
  WHEN nm < 600 THEN '#FFD700' WHEN nm < 640 THEN '#FF6600' ELSE '#FF4444' END"""


@query("x18_wavelength_colour", "", f"SELECT o_orderkey, {BAND} AS colour FROM (SELECT o_orderkey, o_totalprice % 900 - 100 AS nm FROM orders)")
def x18_wavelength_colour(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", fn.wavelength_colour(F.col("o_totalprice") % 900 - 100).alias("colour"))


@query("x19_channel_colours", "", f"""
 c AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'GFP ' || p_type WHEN 1 THEN p_type || ' Cy5' WHEN 2 THEN 'YFP' WHEN 3 THEN 'x cfp dapi' WHEN 4 THEN 'phase ' || p_brand ELSE p_brand END AS suffix,
              CASE WHEN p_partkey % 5 = 0 THEN 380.0::DOUBLE + p_size * 8 END AS nm FROM part),
 nc AS (SELECT * FROM (VALUES ('dapi','#4488FF'),('hoechst','#4488FF'),('nuclear','#4488FF'),('nuc','#4488FF'),('gfp','#00CC44'),('egfp','#00CC44'),('fitc','#00CC44'),('alexa488','#00CC44'),('488','#00CC44'),
   ('yfp','#FFD700'),('cfp','#7B2FBE'),('cy3','#FF6600'),('tritc','#FF6600'),('555','#FF6600'),('561','#FF6600'),('mrfp','#FF6600'),('rfp','#FF6600'),('mcherry','#FF6600'),('cherry','#FF6600'),
   ('cy5','#FF4444'),('alexa647','#FF4444'),('647','#FF4444'),('bf','#FFFFFF'),('brightfield','#FFFFFF'),('dic','#FFFFFF'),('phase','#FFFFFF'),('tl','#FFFFFF')) t(n, colour)),
 w AS (SELECT suffix, unnest(string_split(lower(suffix), ' ')) AS word, generate_subscripts(string_split(lower(suffix), ' '), 1) AS i FROM (SELECT DISTINCT suffix FROM c)),
 m AS (SELECT suffix, arg_min(nc.colour, i) AS colour FROM w JOIN nc ON n = word GROUP BY suffix)
SELECT suffix, nm AS wavelength, CASE WHEN nm IS NOT NULL THEN {BAND} ELSE m.colour END AS colour FROM c LEFT JOIN m USING (suffix)""")
def x19_channel_colours(spark, sf_dir):
    channels = views.table(spark, sf_dir, "part").selectExpr("""case p_partkey % 6 when 0 then concat('GFP ', p_type) when 1 then concat(p_type, ' Cy5')
        when 2 then 'YFP' when 3 then 'x cfp dapi' when 4 then concat('phase ', p_brand) else p_brand end as suffix""",
        "case when p_partkey % 5 = 0 then 380d + p_size * 8 end as wavelength").distinct()
    return fn.channel_colours(channels)


@query("z6_experiment_scan", "gappy_files", f"""{SCORE},
 sf AS (SELECT DISTINCT condition, suffix FROM sets),
 k AS (SELECT *, coalesce(TRY_CAST(regexp_extract(suffix, '([0-9]+)', 1) AS INT), 999) AS natural_key,
       row_number() OVER (PARTITION BY condition ORDER BY coalesce(TRY_CAST(regexp_extract(suffix, '([0-9]+)', 1) AS INT), 999), suffix) AS rn FROM sf),
 n AS (SELECT condition, count(DISTINCT base) AS n_image_sets FROM sets GROUP BY ALL)
SELECT condition, suffix, natural_key, CASE rn WHEN 1 THEN 'nuclear' WHEN 2 THEN 'cyto' ELSE 'marker' END AS role, n_image_sets,
       CASE WHEN rn = 1 THEN '#4488FF' END AS colour
FROM k JOIN n USING (condition)""")
def z6_experiment_scan(spark, sf_dir):
    from rasterlab.plans.analyses import experiment_channels

    wavelengths = views.table(spark, sf_dir, "region").agg((461.0 + F.min("r_regionkey")).alias("wavelength")).withColumn("suffix", F.lit("w1"))
    return experiment_channels(views.gappy_files(spark, sf_dir), wavelengths)
