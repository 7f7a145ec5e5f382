"""The same results in SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from needledrop.workload.views import IS_TEST, SAVED_NODES, SAVED_WEIGHTS, SQL_VIEWS, WRITTEN

_DEPENDS = {
    "tagged": ("plays",),
    "train_tracks": ("tagged",),
    "stats": ("tracks", "train_tracks"),
    "featured": ("tracks", "stats"),
    "enriched": ("tagged", "featured"),
}

_DERIVED = {
    "tagged": "SELECT *, replace(spotify_track_uri, 'spotify:track:', '') AS track_id FROM plays",
    "train_tracks": f"SELECT DISTINCT track_id FROM tagged WHERE NOT ({IS_TEST}) AND track_id IS NOT NULL",
    "stats": """
        SELECT coalesce(avg(duration_ms), 0) AS mean_ms, coalesce(quantile_cont(duration_ms, 0.99), 0) AS p99_ms,
               count(*) AS n
        FROM tracks WHERE duration_ms > 0 AND track_id IN (SELECT track_id FROM train_tracks)""",
    "featured": """
        SELECT track_id,
          CAST(CASE WHEN p99_ms > 0 THEN least(d, p99_ms) / p99_ms ELSE 0 END AS FLOAT) AS duration_normalized,
          CAST(explicit AS INT) AS explicit, CAST(popularity AS FLOAT) AS popularity,
          CAST(track_number AS FLOAT) AS track_number,
          CAST(available_markets_count AS FLOAT) AS available_markets_count, album_type,
          CAST(CASE WHEN y BETWEEN 1678 AND 2261 THEN y END AS FLOAT) AS release_year, d / 60000 AS duration_min
        FROM (SELECT *, CASE WHEN duration_ms = 0 THEN mean_ms ELSE CAST(duration_ms AS DOUBLE) END AS d,
                CASE WHEN length(release_date) = 4 THEN year(TRY_CAST(release_date || '-01-01' AS DATE))
                     WHEN length(release_date) = 7 THEN year(TRY_CAST(release_date || '-01' AS DATE))
                     WHEN length(release_date) = 10 THEN year(TRY_CAST(release_date AS DATE)) END AS y
              FROM tracks CROSS JOIN stats)""",
    "enriched": """
        SELECT p.*, f.duration_normalized, f.explicit, f.popularity, f.track_number, f.available_markets_count,
               f.album_type, f.release_year
        FROM tagged p LEFT JOIN featured f ON p.track_id = f.track_id""",
}


def _with(sql: str, *names: str) -> str:
    ordered: list[str] = []

    def need(name: str) -> None:
        for d in _DEPENDS.get(name, ()):
            need(d)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        need(n)
    body = {**SQL_VIEWS, **_DERIVED}
    return "WITH " + ", ".join(f"{n} AS ({body[n]})" for n in ordered) + " " + sql


PLATFORM = """CASE
  WHEN lower(platform) LIKE '%windows%' THEN 'windows'
  WHEN lower(platform) LIKE '%android%' THEN 'android'
  WHEN lower(platform) LIKE '%ios%' OR lower(platform) LIKE '%iphone%' OR lower(platform) LIKE '%ipad%' THEN 'ios'
  WHEN lower(platform) LIKE '%linux%' THEN 'linux'
  WHEN lower(platform) LIKE '%osx%' OR lower(platform) LIKE '%mac%' OR lower(platform) LIKE '%os x%' THEN 'osx'
  WHEN lower(platform) LIKE '%cast%' THEN 'cast'
  WHEN lower(platform) LIKE '%web%' THEN 'webplayer'
  ELSE 'other' END"""

SECONDS = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))"


def _part(low: int, high: int) -> str:
    return f"CAST({SECONDS} >= {low} AND {SECONDS} < {high} AS TINYINT)"


def _nonzero(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END"


TEMPORAL = f"""
  CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day,
  dayname(ts) AS day_of_week, CAST(dayname(ts) IN ('Saturday', 'Sunday') AS TINYINT) AS is_weekend,
  {_part(21600, 43200)} AS is_morning, {_part(43200, 64800)} AS is_afternoon, {_part(64800, 79200)} AS is_evening,
  CAST(1 AS TINYINT) AS is_night,
  {_nonzero(f"round(sin(2 * pi() * {SECONDS} / 86400), 9)")} AS time_of_day_sin,
  {_nonzero(f"round(cos(2 * pi() * {SECONDS} / 86400), 9)")} AS time_of_day_cos"""

SONG_AGE = "CASE WHEN year(ts) - release_year >= 0 THEN CAST(year(ts) - release_year AS DOUBLE) ELSE 0.0 END"


def _track_order(by: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY {by}, CAST(ts AS DATE) ORDER BY ts, obs_id) AS INT)"


def _trailing(minutes: int, by: str) -> str:
    return (
        f"count(*) OVER (PARTITION BY {by} ORDER BY epoch_us(ts) "
        f"RANGE BETWEEN {minutes * 60000000} PRECEDING AND 1 PRECEDING)"
    )


def _trailing_all(by: str) -> str:
    spans = {"40min": 40, "1h": 60, "6h": 360, "12h": 720, "24h": 1440}
    return ", ".join(f"{_trailing(m, by)} AS songs_total_{n}" for n, m in spans.items())


TRACK_ORDER = _track_order("username")
ROLLING = f"""
  count(*) OVER (PARTITION BY username ORDER BY epoch_us(ts) // 1200000000
                 RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS songs_total_20min,
  {_trailing_all("username")}"""


def _split(source: str, user: str = "username", where: str = "TRUE") -> str:
    return f"""
      SELECT *, CASE WHEN rk < greatest(1, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT))
                     THEN 'train' ELSE 'val' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY {user} ORDER BY CAST(ts AS DATE), obs_id) - 1 AS rk,
                   count(*) OVER (PARTITION BY {user}) AS n FROM {source} WHERE {where})"""


def _mode(column: str, source: str) -> str:
    return (
        f"(SELECT v FROM (SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL "
        f"GROUP BY {column}) ORDER BY n DESC, v LIMIT 1)"
    )


LEARN = f"(SELECT * FROM plays WHERE NOT ({IS_TEST}))"
NUMBERS = ("value", "value_nullable", "k")
TEXTS = ("platform", "conn_country", "shuffle")


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


LONG_NUMBERS = _union(
    [f"SELECT '{c}' AS \"column\", fwdbtn AS target, CAST({c} AS DOUBLE) AS v FROM plays WHERE {c} IS NOT NULL" for c in NUMBERS]
)
LONG_TEXTS = _union(
    [f"SELECT '{c}' AS \"column\", fwdbtn AS target, CAST({c} AS VARCHAR) AS value FROM plays WHERE {c} IS NOT NULL" for c in TEXTS]
)


def _inferred(column: str) -> str:
    def every(test: str) -> str:
        return f"bool_and({test}) FILTER (WHERE {column} IS NOT NULL)"

    number = f"TRY_CAST({column} AS DOUBLE) IS NOT NULL"
    return f"""
      SELECT '{column}' AS "column",
        CASE WHEN count({column}) = 0 THEN 'void'
             WHEN {every(f"{column} IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')")} THEN 'boolean'
             WHEN {every(f"regexp_full_match({column}, '[+-]?[0-9]+') AND TRY_CAST({column} AS BIGINT) IS NOT NULL")} THEN 'bigint'
             WHEN {every(f"{column} NOT IN ('True', 'False') AND {number}")} THEN 'double'
             ELSE 'string' END AS type,
        count({column}) AS n_values, count(*) - count({column}) AS n_missing
      FROM written"""


def _staged_auc() -> str:
    def tree(number: int, at: int = 0) -> str:
        _, _, feature, threshold, left, right, value = next(n for n in SAVED_NODES if n[:2] == (number, at))
        if feature < 0:
            return f"{value}e0"
        return f"CASE WHEN {('coalesce(k, -1)', 'value')[feature]} <= {threshold}e0 THEN {tree(number, left)} ELSE {tree(number, right)} END"

    each = ", ".join(f"{w}e0 * ({tree(i)}) AS t{i}" for i, w in enumerate(SAVED_WEIGHTS))
    sums = " UNION ALL ".join(
        f"SELECT {n + 1} AS round, fwdbtn AS y, 0e0 + {' + '.join(f't{i}' for i in range(n + 1))} AS m FROM trees" for n in range(len(SAVED_WEIGHTS))
    )
    return f"""
      SELECT grid, round, round(CAST(sum(p * (cn + n / 2.0)) AS DOUBLE) / (sum(p) * sum(n)), 6) AS auc,
        round(CASE WHEN grid > 0 THEN sum(p * n) / 2 / (sum(p) * sum(n)) ELSE 0 END, 6) AS error
      FROM (SELECT grid, round, p, n, sum(n) OVER (PARTITION BY grid, round ORDER BY s) - n AS cn
            FROM (SELECT grid, round, CASE WHEN grid > 0 THEN floor(grid / (1 + exp(-2 * m))) ELSE m END AS s,
                    CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n
                  FROM (WITH trees AS (SELECT fwdbtn, {each} FROM plays) {sums}) CROSS JOIN (SELECT unnest([0, 64]) AS grid)
                  GROUP BY ALL))
      GROUP BY grid, round"""


def _auc(score: str) -> str:
    return f"""
      SELECT '{score}' AS "by", round(CAST(sum(p * (cn + n / 2.0)) AS DOUBLE) / (sum(p) * sum(n)), 6) AS auc
      FROM (SELECT p, n, sum(n) OVER (ORDER BY s) - n AS cn
            FROM (SELECT {score} AS s, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n
                  FROM scored GROUP BY {score}))"""


def _class_row(k: int) -> str:
    return f"""
      SELECT '{k}' AS label, tp / nullif(pp, 0) AS precision, tp / nullif(s, 0) AS recall,
             2 * tp / nullif(pp + s, 0) AS f1, s AS support
      FROM (SELECT CAST(count(*) FILTER (y = {k} AND pred = {k}) AS DOUBLE) AS tp,
                   CAST(count(*) FILTER (pred = {k}) AS DOUBLE) AS pp,
                   CAST(count(*) FILTER (y = {k}) AS DOUBLE) AS s FROM scored)"""


def _stats(long: str) -> str:
    return f"""
      SELECT "column", target, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
             round(quantile_cont(v, 0.5), 6) AS median, count(DISTINCT v) AS n_distinct
      FROM ({long}) GROUP BY "column", target"""


def _wide(name: str, column: str, value: str) -> str:
    return f"CASE WHEN {column} = '{value}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"cat__{name}_{value}\""


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["json_extract"] = "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, '' AS missing FROM events"
    q["drop_all_null_columns"] = _with("SELECT * EXCLUDE (audiobook_title, ts, shuffle) FROM plays", "plays")
    q["label_binarize"] = (
        "SELECT event_id AS obs_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS fwdbtn FROM events"
    )
    q["safe_numeric_cast"] = _with(
        "SELECT obs_id, CASE WHEN k % 11 > 1 THEN CAST(k + 0.5 AS FLOAT) END AS number FROM plays", "plays"
    )
    q["fill_constants"] = _with(
        """SELECT obs_id, CAST(coalesce(shuffle, FALSE) AS TINYINT) AS shuffle,
                  coalesce(platform, 'unknown') AS platform, coalesce(conn_country, 'unknown') AS conn_country
           FROM plays""",
        "plays",
    )
    q["track_event_flags"] = _with(
        """SELECT obs_id, CAST(master_metadata_track_name IS NOT NULL AS TINYINT) AS is_song,
                  CAST(episode_name IS NOT NULL AS TINYINT) AS is_episode FROM plays""",
        "plays",
    )
    q["column_roles"] = _with(
        _union(
            [
                f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 2 AND "
                f"count(*) FILTER ({c} NOT IN (0, 1)) = 0 THEN 'categorical' ELSE 'numeric' END AS role FROM labeled_docs"
                for c in ("n_chars", "quality", "toxic")
            ]
            + [f"SELECT '{c}', 'categorical'" for c in ("lang", "source", "nothing")]
        ),
        "labeled_docs",
    )
    q["distinct_train_tracks"] = _with("SELECT track_id FROM train_tracks", "train_tracks")
    q["duration_stats_train_only"] = _with(
        "SELECT round(mean_ms, 6) AS mean_ms, round(p99_ms, 6) AS p99_ms, n FROM stats", "stats"
    )
    q["track_features"] = _with(
        """SELECT * REPLACE (round(CAST(duration_normalized AS DOUBLE), 5) AS duration_normalized,
                             round(duration_min, 6) AS duration_min) FROM featured""",
        "featured",
    )
    q["release_year"] = _with("SELECT track_id, CAST(release_year AS INT) AS release_year FROM featured", "featured")
    q["track_id_extract"] = _with(
        "SELECT obs_id, substr(spotify_track_uri, 15) AS track_id FROM plays", "plays"
    )
    q["enrich_left_join"] = _with(
        """SELECT obs_id, track_id, round(CAST(duration_normalized AS DOUBLE), 5) AS duration_normalized, explicit,
                  popularity, track_number, available_markets_count, album_type, release_year FROM enriched""",
        "enriched",
    )
    q["join_coverage"] = _with(
        """SELECT round(count(duration_normalized) / count(*), 6) AS coverage, count(duration_normalized) AS matched,
                  count(*) AS total FROM enriched""",
        "enriched",
    )
    q["temporal_features"] = _with(
        f"""SELECT obs_id, {TEMPORAL},
                   CAST({SECONDS} >= 79200 OR {SECONDS} < 21600 AS TINYINT) AS is_night_corrected FROM plays""",
        "plays",
    )
    q["platform_map"] = _with(f"SELECT obs_id, {PLATFORM} AS platform FROM plays", "plays")
    q["song_age"] = _with(f"SELECT obs_id, {SONG_AGE} AS song_age FROM enriched", "enriched")
    q["track_order_in_day"] = _with(f"SELECT obs_id, {TRACK_ORDER} AS track_order_in_day FROM minute_plays", "minute_plays")
    q["track_order_in_day_heavy"] = _with(
        f"SELECT obs_id, {TRACK_ORDER} AS track_order_in_day FROM user_orders", "user_orders"
    )
    q["rolling_counts"] = _with(f"SELECT obs_id, {ROLLING} FROM plays", "plays")
    q["rolling_counts_tied"] = _with(f"SELECT obs_id, {ROLLING} FROM minute_plays", "minute_plays")
    q["rolling_counts_heavy"] = _with(f"SELECT obs_id, {ROLLING} FROM heavy_plays", "heavy_plays")
    q["user_rate_past"] = _with(
        f"""SELECT obs_id, round(CASE WHEN n > 0 THEN s / n WHEN gn > 0 THEN gs / gn END, 9) AS per_user_skip_rate
            FROM (SELECT *, sum(y) OVER own AS s, count(y) OVER own AS n, sum(y) OVER days AS gs, count(y) OVER days AS gn
                  FROM (SELECT *, CASE WHEN NOT ({IS_TEST}) THEN CAST(fwdbtn AS DOUBLE) END AS y, CAST(ts AS DATE) AS d FROM heavy_plays)
                  WINDOW own AS (PARTITION BY username ORDER BY ts, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    days AS (ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))""",
        "heavy_plays",
    )
    q["rolling_bin20_documented"] = _with(
        "SELECT obs_id, count(*) OVER (PARTITION BY username, epoch_us(ts) // 1200000000) AS songs_bin_20min FROM plays",
        "plays",
    )
    q["time_split"] = _with(f"SELECT obs_id, split FROM ({_split('plays')})", "plays")
    q["time_split_dates"] = _with(f"SELECT obs_id, split FROM ({_split('user_orders')})", "user_orders")
    q["time_split_heavy"] = _with(f"SELECT obs_id, split FROM ({_split('heavy_orders')})", "heavy_orders")
    # Counts over all plays of a user, the split over the train plays alone.
    bins = "count(*) OVER (PARTITION BY username, epoch_us(ts) // 1200000000) AS songs_bin_20min"
    q["history_across_frames"] = _with(
        f"""SELECT p.*, coalesce(s.split, 'test') AS split
            FROM (SELECT obs_id, {bins}, {_trailing_all("username")} FROM plays) p
            LEFT JOIN ({_split('plays', where=f'NOT ({IS_TEST})')}) s ON p.obs_id = s.obs_id""",
        "plays",
    )
    in_test = f"({IS_TEST} OR username < 5)"
    q["user_skip_rate"] = _with(
        f"""SELECT p.obs_id, coalesce(s.split, 'test') AS split,
                   round(coalesce(r.rate, (SELECT avg(fwdbtn) FROM folded WHERE split = 'train')), 9) AS per_user_skip_rate
            FROM plays p LEFT JOIN folded s ON p.obs_id = s.obs_id
            LEFT JOIN (SELECT username, avg(fwdbtn) AS rate FROM folded WHERE split = 'train' GROUP BY username) r
              ON p.username = r.username""",
        "plays",
    ).replace(" SELECT p.obs_id", f", folded AS ({_split('plays', where=f'NOT {in_test}')}) SELECT p.obs_id", 1)
    q["user_skip_rate_joined"] = _with(
        f"""SELECT p.obs_id, round(coalesce(r.rate, (SELECT avg(fwdbtn) FROM {LEARN})), 9) AS per_user_skip_rate
            FROM plays p LEFT JOIN (SELECT username, avg(fwdbtn) AS rate FROM {LEARN} GROUP BY username) r
              ON p.username = r.username""",
        "plays",
    )
    # The best split of the squared error of a label of -1 or 1 lies where s1^2/n1 + s2^2/n2 is largest.
    q["stump_split"] = _with(
        f"""SELECT threshold, k <= threshold AS "left", count(*) AS n, CAST(sum(fwdbtn) AS BIGINT) AS positives
            FROM (SELECT coalesce(k, -1) AS k, fwdbtn FROM plays WHERE NOT ({IS_TEST}))
            CROSS JOIN (SELECT (k + next) / 2.0::DOUBLE AS threshold
                        FROM (SELECT k, lead(k) OVER o AS next, sum(n) OVER o AS n1, sum(s) OVER o AS s1, sum(n) OVER () AS n, sum(s) OVER () AS s
                              FROM (SELECT coalesce(k, -1) AS k, count(*)::DOUBLE AS n, sum(2 * fwdbtn - 1)::DOUBLE AS s
                                    FROM plays WHERE NOT ({IS_TEST}) GROUP BY 1)
                              WINDOW o AS (ORDER BY k))
                        WHERE next IS NOT NULL
                        ORDER BY s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) DESC LIMIT 1)
            GROUP BY ALL""",
        "plays",
    )
    framed = " || ".join(
        f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("epoch_us(ts)", "username", "fwdbtn", "spotify_track_uri")
    )
    sums = ", ".join(f"CAST(sum(CAST('0x' || substring(h, {i}, 8) AS BIGINT)) AS VARCHAR) AS sum_{i}" for i in (1, 9, 17, 25))
    q["frame_fingerprint"] = _with(f"SELECT count(*) AS n_rows, {sums} FROM (SELECT md5({framed}) AS h FROM plays)", "plays")
    q["timestamp_parse"] = _with(
        """SELECT obs_id, epoch_us(date_trunc('second', ts)) - CASE obs_id % 4 WHEN 2 THEN 7200 WHEN 3 THEN -12600 ELSE 0 END * 1000000::BIGINT
             AS micros FROM plays""",
        "plays",
    )
    q["flatten_documents"] = """
        SELECT CAST(p_partkey AS VARCHAR) AS track_id,
               CAST(CASE p_partkey % 4 WHEN 1 THEN p_size * 1000 + 0.5 WHEN 3 THEN p_size * 1000 ELSE 0 END AS DOUBLE) AS duration_ms,
               p_partkey % 5 IN (0, 1) AS explicit,
               CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END AS popularity,
               2 AS available_markets_count, CAST(p_partkey % 7 AS VARCHAR) AS album_type FROM part"""
    q["importance_top"] = """
        SELECT 'f' || p_partkey AS feature, CAST(p_size AS DOUBLE) / 50 AS importance FROM part
        ORDER BY importance DESC, feature LIMIT 20"""
    q["feature_table"] = _with(
        f"""SELECT obs_id, {TEMPORAL}, username, value, reason_end, {PLATFORM} AS platform, conn_country,
                   explicit, popularity, track_number, available_markets_count, album_type, release_year,
                   round(CAST(duration_normalized AS DOUBLE), 5) AS duration_normalized,
                   CAST(master_metadata_track_name IS NOT NULL AS TINYINT) AS is_song,
                   CAST(episode_name IS NOT NULL AS TINYINT) AS is_episode, {SONG_AGE} AS song_age,
                   {TRACK_ORDER} AS track_order_in_day, {ROLLING}, fwdbtn FROM enriched""",
        "enriched",
    )
    in_frame = f"username, ({IS_TEST})"
    numbers = (
        "year month day is_weekend is_morning is_afternoon is_evening is_night time_of_day_sin time_of_day_cos value "
        "is_song is_episode explicit popularity track_number available_markets_count release_year duration_normalized "
        "song_age track_order_in_day songs_bin_20min songs_total_40min songs_total_1h songs_total_6h songs_total_12h "
        "songs_total_24h per_user_skip_rate"
    ).split()
    texts = ("day_of_week", "platform", "conn_country", "album_type", "username")
    medians = ", ".join(
        _nonzero(f"round(CAST(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM learn)) AS DOUBLE), 5)") + f" AS {c}"
        for c in numbers
    )
    modes = ", ".join(f"coalesce({c}, {_mode(c, 'learn')}) AS {c}" for c in texts)
    folds = (
        f"SELECT obs_id, username, fwdbtn, split FROM ({_split('tagged', where=f'NOT ({IS_TEST})')}) "
        f"UNION ALL SELECT obs_id, username, NULL, 'test' FROM tagged WHERE {IS_TEST}"
    )
    table = f"""
        SELECT e.obs_id, CAST(e.username AS VARCHAR) AS username, s.split, s.fwdbtn, {TEMPORAL}, value, {PLATFORM} AS platform,
               conn_country, album_type, CAST(master_metadata_track_name IS NOT NULL AS TINYINT) AS is_song,
               CAST(episode_name IS NOT NULL AS TINYINT) AS is_episode, explicit, popularity, track_number,
               available_markets_count, release_year, duration_normalized, {SONG_AGE} AS song_age,
               track_order_in_day, songs_bin_20min, songs_total_40min, songs_total_1h, songs_total_6h, songs_total_12h,
               songs_total_24h, coalesce(rate, (SELECT avg(fwdbtn) FROM folds WHERE split = 'train')) AS per_user_skip_rate
        FROM enriched e JOIN folds s ON e.obs_id = s.obs_id
        JOIN (SELECT obs_id AS o, {_track_order(in_frame)} AS track_order_in_day, {_trailing_all(in_frame)},
                     count(*) OVER (PARTITION BY {in_frame}, epoch_us(ts) // 1200000000) AS songs_bin_20min
              FROM plays) c ON e.obs_id = c.o
        LEFT JOIN (SELECT username AS u, avg(fwdbtn) AS rate FROM folds WHERE split = 'train' GROUP BY username) r
          ON e.username = r.u"""
    q["imputed_dataset"] = _with(
        f"SELECT obs_id, split, CAST(fwdbtn AS INT) AS fwdbtn, {medians}, {modes} FROM dataset", "enriched"
    ).replace(
        " SELECT obs_id, split, CAST",
        f", folds AS ({folds}), dataset AS ({table}), learn AS (SELECT * FROM dataset WHERE split = 'train') "
        "SELECT obs_id, split, CAST",
        1,
    )
    q["impute_median_mode"] = _with(
        f"""SELECT obs_id, round(coalesce(value_nullable,
                     (SELECT quantile_cont(value_nullable, 0.5) FROM {LEARN})), 6) AS value_nullable,
                   coalesce(platform, {_mode('platform', LEARN)}) AS platform,
                   coalesce(conn_country, {_mode('conn_country', LEARN)}) AS conn_country FROM plays""",
        "plays",
    )
    late = f"CASE WHEN {IS_TEST} AND k % 9 = 0 THEN 'new' ELSE conn_country END"
    late_plays = f"(SELECT obs_id, ts, {late} AS c FROM plays)"
    late_learn = f"(SELECT * FROM {late_plays} WHERE NOT ({IS_TEST}))"
    q["rare_category_encode"] = _with(
        f"""SELECT f.obs_id, CASE WHEN n >= 0.01 * (SELECT count(*) FROM {late_learn}) THEN f.c
                               WHEN n > 0 THEN 'infrequent_sklearn' END AS category
            FROM (SELECT obs_id, coalesce(c, {_mode('c', late_learn)}) AS c FROM {late_plays}) f
            LEFT JOIN (SELECT coalesce(c, {_mode('c', late_learn)}) AS c, count(*) AS n FROM {late_learn} GROUP BY 1) g
              ON f.c = g.c""",
        "plays",
    )
    country = "CASE WHEN k = 0 AND obs_id % 2 = 0 THEN 'XX' WHEN k < 50 THEN 'AR' WHEN k < 95 THEN 'US' END"
    base = f"(SELECT obs_id, ts, value_nullable, {PLATFORM} AS platform, {country} AS country FROM plays)"
    base_learn = f"(SELECT * FROM {base} WHERE NOT ({IS_TEST}))"
    families = ("android", "ios", "linux", "osx", "other", "webplayer", "windows", "cast")
    q["encoded_wide"] = _with(
        f"""SELECT obs_id, coalesce(value_nullable, (SELECT quantile_cont(value_nullable, 0.5) FROM {base_learn}))
                     AS num__value_nullable,
                   {", ".join(_wide("platform", "platform", p) for p in families)},
                   {_wide("country", "c", "AR")}, {_wide("country", "c", "US")},
                   CASE WHEN c = 'XX' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cat__country_infrequent_sklearn
            FROM (SELECT *, coalesce(country, {_mode('country', base_learn)}) AS c FROM {base})""",
        "plays",
    )
    q["target_distribution"] = """
        SELECT quality, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct,
               round(100.0 * count(*) / (SELECT count(*) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), 6)
                 AS pct_of_rows
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL GROUP BY quality"""
    q["class_conditional_stats"] = _with(_stats(LONG_NUMBERS), "plays")
    q["class_conditional_stats_docs"] = _with(
        _stats("SELECT 'n_chars' AS \"column\", quality AS target, CAST(n_chars AS DOUBLE) AS v FROM labeled_docs"),
        "labeled_docs",
    )
    q["class_category_counts"] = _with(
        f"""SELECT "column", value, count(*) FILTER (target = 0) AS count_0, count(*) FILTER (target = 1) AS count_1
            FROM ({LONG_TEXTS}) GROUP BY "column", value""",
        "plays",
    )
    q["class_category_union"] = _with(f"SELECT DISTINCT \"column\", value FROM ({LONG_TEXTS})", "plays")
    spans = f"""SELECT "column", target, count(*) AS total, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd
                FROM ({LONG_NUMBERS}) GROUP BY "column", target"""
    q["class_histogram"] = _with(
        f"""SELECT s."column", s.target, CAST(b AS INT) AS bin, round(lo + b * w, 6) AS lower,
                   round(lo + (b + 1) * w, 6) AS upper, coalesce(n, 0) AS n,
                   round(coalesce(n, 0) / (total * w), 6) AS density
            FROM (SELECT *, (hi - lo) / 50 AS w FROM ({spans})) s CROSS JOIN range(50) r(b)
            LEFT JOIN (SELECT l."column", l.target, e.b AS bin, count(*) AS n
                       FROM ({LONG_NUMBERS}) l
                       JOIN (SELECT "column", target, b, lo + b * ((hi - lo) / 50) AS lower, lo + (b + 1) * ((hi - lo) / 50) AS upper
                             FROM ({spans}) CROSS JOIN range(50) r(b)) e
                         ON l."column" = e."column" AND l.target = e.target
                        AND (v >= e.lower OR e.b = 0) AND (v < e.upper OR e.b = 49)
                       GROUP BY 1, 2, 3) c
              ON s."column" = c."column" AND s.target = c.target AND r.b = c.bin""",
        "plays",
    )
    q["class_kde"] = _with(
        f"""SELECT s."column", s.target, CAST(i AS INT) AS point, round(lo + i * (hi - lo) / 199, 6) AS x,
                   round(sum(exp(-0.5 * pow((v - (lo + i * (hi - lo) / 199)) / h, 2))) / (max(total) * max(h) * sqrt(2 * pi())), 9)
                     AS density
            FROM (SELECT *, pow(total, CAST(-0.2 AS DOUBLE)) * sd AS h FROM ({spans})) s CROSS JOIN range(200) r(i)
            JOIN ({LONG_NUMBERS}) l ON l."column" = s."column" AND l.target = s.target
            GROUP BY s."column", s.target, i, lo, hi""",
        "plays",
    )
    # The mesh and reach of a tolerance of 1e-6.
    mesh, reach = "h * sqrt(8 * 0.9 * 1e-6)", "h * sqrt(-2 * ln(0.1 * 1e-6))"
    curve = f"(SELECT *, pow(total, CAST(-0.2 AS DOUBLE)) * sd AS h FROM ({spans}))"
    q["class_kde_binned"] = _with(
        f"""SELECT s."column", s.target, CAST(i AS INT) AS point, round(lo + i * (hi - lo) / 199, 6) AS x,
                   round(coalesce(sum(CASE WHEN abs(pos - i * (hi - lo) / 199) <= {reach} THEN m * exp(-0.5 * pow((pos - i * (hi - lo) / 199) / h, 2)) END), 0)
                         / (total * h * sqrt(2 * pi())), 9) AS density,
                   round(1e-6 / (h * sqrt(2 * pi())), 9) AS error
            FROM {curve} s CROSS JOIN range(200) r(i)
            JOIN (SELECT "column", target, (c + e) * d AS pos, CASE e WHEN 0 THEN w - f ELSE f END AS m
                  FROM (SELECT l."column", l.target, {mesh} AS d, floor((v - lo) / ({mesh})) AS c, count(*) AS w,
                               sum((v - lo) / ({mesh}) - floor((v - lo) / ({mesh}))) AS f
                        FROM ({LONG_NUMBERS}) l JOIN {curve} k ON l."column" = k."column" AND l.target = k.target
                        GROUP BY ALL) CROSS JOIN range(2) t(e)) b
              ON b."column" = s."column" AND b.target = s.target
            GROUP BY s."column", s.target, i, lo, hi, h, total""",
        "plays",
    )
    # Sketches are not SQL: their bounds are, with the exact counts.
    q["quantile_sketch"] = _with(
        f"""SELECT target AS fwdbtn, "column", p AS prob, count(*) AS n, TRUE AS within
            FROM ({LONG_NUMBERS}) CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.25, 0.5, 0.75, 0.99]) AS p) GROUP BY ALL""",
        "plays",
    )
    q["distinct_sketch"] = _with(
        " UNION ALL ".join(
            f"""SELECT fwdbtn, '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS exact, TRUE AS within FROM plays GROUP BY fwdbtn"""
            for c in ("username", "obs_id", "platform")
        ),
        "plays",
    )
    q["dataset_summary"] = _with(
        f"""SELECT split, count(*) AS n_rows, count(DISTINCT username) AS n_users, count(DISTINCT track_id) AS n_tracks,
                   min(obs_id) AS min_obs_id, max(obs_id) AS max_obs_id, CAST(sum(fwdbtn) AS BIGINT) AS n_positive
            FROM (SELECT split, username, track_id, obs_id, fwdbtn FROM ({_split('tagged', where=f'NOT ({IS_TEST})')})
                  UNION ALL SELECT 'test', username, track_id, obs_id, fwdbtn FROM tagged WHERE {IS_TEST})
            GROUP BY split""",
        "tagged",
    )
    q["roc_auc"] = _with(_auc("score") + " UNION ALL " + _auc("fine_score"), "scored")
    q["infer_types"] = _with(" UNION ALL ".join(_inferred(c) for c in WRITTEN), "written")
    q["staged_auc"] = _with(_staged_auc(), "plays")
    q["classification_report"] = _with(
        """SELECT label, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall,
                  round(coalesce(f1, 0), 6) AS f1, CAST(support AS BIGINT) AS support
           FROM (SELECT * FROM classes
                 UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT avg(CAST(y = pred AS INT)) AS a, count(*) AS s FROM scored)
                 UNION ALL SELECT 'macro avg', avg(coalesce(precision, 0)), avg(coalesce(recall, 0)),
                                  avg(coalesce(f1, 0)), sum(support) FROM classes
                 UNION ALL SELECT 'weighted avg', sum(coalesce(precision, 0) * support) / sum(support),
                                  sum(coalesce(recall, 0) * support) / sum(support),
                                  sum(coalesce(f1, 0) * support) / sum(support), sum(support) FROM classes)""",
        "scored",
    ).replace(" SELECT label, round", f", classes AS ({_class_row(0)} UNION ALL {_class_row(1)}) SELECT label, round", 1)
    q["trial_summary"] = _with(
        """SELECT tid, max_depth, mean_cv_score, -mean_cv_score AS loss, CAST(0 AS DOUBLE) AS std_cv_score,
                  tid = (SELECT tid FROM trials ORDER BY mean_cv_score DESC, tid LIMIT 1) AS is_best
           FROM trials ORDER BY mean_cv_score DESC, tid LIMIT 5""",
        "trials",
    )
    q["predictions_with_ids"] = _with(
        f"""SELECT 'own' AS ids, obs_id, round(value / 1000, 6) AS target FROM plays WHERE {IS_TEST}
            UNION ALL SELECT 'counted', row_number() OVER (ORDER BY obs_id) - 1, round(value / 1000, 6)
            FROM plays WHERE {IS_TEST}""",
        "plays",
    )
    return q
