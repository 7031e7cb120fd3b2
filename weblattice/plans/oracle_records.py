"""The typed records of raw_records in SQL, for the queries that read them."""

_FIELD = r',(?:"(?:[^"]|"")*"|[^,]*)'
_VALID = r'(?:"(?:[^"]|"")*"|[^",][^,]*|)(?:,(?:"(?:[^"]|"")*"|[^",][^,]*|))*'
_UNQUOTE = """CASE WHEN f[2:2] = '"' THEN replace(f[3:length(f) - 1], '""', '"') ELSE f[2:] END"""
_TRIM = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"

RECORDS = rf"""hdr AS (
  SELECT run_id, source_document, export, regexp_replace(arg_min(raw, record_id), '^\x{{FEFF}}', '') AS h FROM raw_records WHERE line_number = 1 AND raw IS NOT NULL GROUP BY ALL),
hf AS (SELECT run_id, source_document, export, regexp_full_match(h, '{_VALID}') AS h_ok,
  list_transform(regexp_extract_all(',' || h, '{_FIELD}'), lambda f: lower(regexp_replace({_TRIM.format(_UNQUOTE)}, '^\x{{FEFF}}', ''))) AS names FROM hdr),
rec AS (SELECT *, regexp_replace(raw, '^\x{{FEFF}}', '') AS x FROM raw_records WHERE line_number IS DISTINCT FROM 1 AND regexp_matches(raw, '[^\s\x{{FEFF}}]')),
cut AS (SELECT r.*, h_ok, names, regexp_full_match(x, '{_VALID}') AS ok, list_transform(regexp_extract_all(',' || x, '{_FIELD}'), lambda f: {_TRIM.format(_UNQUOTE)}) AS v
  FROM rec r LEFT JOIN hf ON r.run_id IS NOT DISTINCT FROM hf.run_id AND r.source_document IS NOT DISTINCT FROM hf.source_document AND r.export IS NOT DISTINCT FROM hf.export),
named AS (SELECT *, v[list_position(names, 'source_url')] AS su, v[list_position(names, 'target_url')] AS tu, v[list_position(names, 'clicks')] AS cl,
  v[list_position(names, 'address')] AS ad, v[list_position(names, 'status code')] AS st, v[list_position(names, 'crawl depth')] AS dp,
  coalesce(h_ok, false) AND list_has_all(names, CASE export WHEN 'analytics' THEN ['source_url', 'target_url', 'clicks'] WHEN 'internal' THEN ['address', 'status code', 'crawl depth'] ELSE ['?'] END) AS usable FROM cut),
judged AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN NOT usable THEN 'header' WHEN len(v) != len(names) THEN 'columns'
  WHEN export = 'analytics' AND (su = '' OR tu = '' OR NOT regexp_full_match(cl, '[0-9]+') OR TRY_CAST(cl AS HUGEINT) IS NULL OR TRY_CAST(cl AS HUGEINT) > 9007199254740991) THEN 'value'
  WHEN export = 'internal' AND (ad = '' OR NOT (st = '' OR (regexp_full_match(st, '[+-]?[0-9]+') AND (TRY_CAST(st AS HUGEINT) = 0 OR TRY_CAST(st AS HUGEINT) BETWEEN 100 AND 599)))
    OR NOT regexp_full_match(dp, '[0-9]*')) THEN 'value' END AS reason FROM named),
loaded AS (SELECT record_id, run_id, export, source_document, line_number, CASE export WHEN 'analytics' THEN su END AS source_url, CASE export WHEN 'analytics' THEN tu END AS target_url,
  CASE export WHEN 'analytics' THEN CAST(cl AS BIGINT) END AS clicks, CASE export WHEN 'internal' THEN ad END AS address,
  CASE WHEN export = 'internal' AND st != '' THEN CAST(st AS INTEGER) END AS status_code, CASE WHEN export = 'internal' AND dp != '' THEN CAST(least(TRY_CAST(dp AS HUGEINT), 9223372036854775807) AS BIGINT) END AS crawl_depth
  FROM judged WHERE reason IS NULL)
"""
