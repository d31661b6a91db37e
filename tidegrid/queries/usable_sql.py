"""DuckDB text for usable samples, as a WITH clause that ends in `usable`."""

USABLE = r"""
info AS (SELECT metric_name, metric_kind, grid_ms,
    CASE WHEN isnan(low_limit) THEN NULL ELSE low_limit END AS low_limit,
    CASE WHEN isnan(high_limit) THEN NULL ELSE high_limit END AS high_limit FROM metric_info),
series AS (SELECT s.series_ref, s.metric_name, s.labels, s.min_ts, s.max_ts, i.metric_kind, i.grid_ms, i.low_limit, i.high_limit,
    array_to_string(list_sort(list_transform(map_entries(s.labels), lambda x: x.key || chr(1) || x.value)), chr(2)) AS canon
    FROM series_catalog s JOIN info i USING (metric_name)),
split AS (SELECT row_id, series_ref, sample_ts, labels, string_split(labels, ' ') AS p, sample_value, trim(value_text, E' \t\n\r') AS txt FROM tsdb_documents),
docs AS (SELECT row_id, series_ref, sample_ts, labels,
    array_to_string(list_sort(list_distinct(list_transform(range(1, len(p) // 2 + 1), lambda i: p[2 * i - 1] || chr(1) || p[2 * i]))), chr(2)) AS canon,
    COALESCE(sample_value, CASE WHEN txt = '+Inf' THEN 'inf'::DOUBLE WHEN txt = '-Inf' THEN '-inf'::DOUBLE
        WHEN regexp_full_match(txt, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN txt::DOUBLE END) AS value FROM split),
usable AS (
    SELECT d.row_id, d.sample_ts, d.value, s.* EXCLUDE (canon) FROM docs d JOIN series s ON d.labels IS NOT NULL AND d.canon = s.canon
        WHERE d.value IS NOT NULL AND d.sample_ts BETWEEN s.min_ts AND s.max_ts
    UNION ALL
    SELECT d.row_id, d.sample_ts, d.value, s.* EXCLUDE (canon) FROM docs d JOIN series s ON d.labels IS NULL AND d.series_ref = s.series_ref
        WHERE d.value IS NOT NULL AND d.sample_ts BETWEEN s.min_ts AND s.max_ts)
"""
