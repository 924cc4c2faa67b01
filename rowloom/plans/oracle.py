"""For each registered query the same result in plain SQL, over the same tables."""

from __future__ import annotations

from rowloom.rules import DEFAULT_HEADER_PATTERNS, DEFAULT_TYPE_OVERRIDES

SPACE = r"[\t\n\x0B\f\r ]"
QUOTE = '"'


# --- pieces ------------------------------------------------------------------------------


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sep_literal(sep: str) -> str:
    return "chr(9)" if sep == "\t" else literal(sep)


def number(v: str) -> str:
    """English or German number, NULL if it is none."""
    pattern = rf"^{SPACE}*[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?{SPACE}*$"
    return (
        f"CASE WHEN regexp_matches({v}, {literal(pattern)}) "
        f"AND abs(TRY_CAST(replace({v}, ',', '.') AS DOUBLE)) < 1e308 "
        f"THEN TRY_CAST(replace({v}, ',', '.') AS DOUBLE) END"
    )


def lenient(v: str) -> str:
    core = r"([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
    pattern = (
        rf"^{SPACE}*([+-]?¤?{core}¤?|¤?[+-]{core}|¤?{core}{SPACE}*[+-]¤?|\(¤?{core}¤?\)){SPACE}*$"
    )
    bare = f"regexp_replace({v}, '[^0-9.eE+-]', '', 'g')"
    sign = f"CASE WHEN contains({v}, '(') OR ends_with({bare}, '-') THEN -1.0 ELSE 1.0 END"
    return (
        f"CASE WHEN regexp_matches({v}, {literal(pattern)}) "
        f"THEN {sign} * TRY_CAST(regexp_replace({bare}, '[+-]$', '') AS DOUBLE) END"
    )


def date(v: str) -> str:
    """Year first, German, or day first; NULL if it is no valid date."""
    time = r"([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?( ?[AaPp][Mm]|Z)?)?"
    shape = (
        rf"^{SPACE}*([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}"
        rf"|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}|[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}"
        rf"|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}){time}{SPACE}*$"
    )
    days = ["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d-%m-%Y", "%d/%m/%Y"]
    whole = [" %H:%M", " %H:%M:%S", " %H:%M:%S.%f"]
    times = ["", *whole, *(t + "Z" for t in whole)]
    halves = [t.replace("%H", "%I") + space + "%p" for t in whole for space in (" ", "")]
    half_formats = ", ".join(literal(d + t) for d in days for t in halves)
    formats = ", ".join(literal(d + t) for d in days for t in times)
    return (
        f"CASE WHEN regexp_matches({v}, {literal(shape)}) "
        f"THEN CASE WHEN regexp_matches({v}, '[AaPp][Mm]{SPACE}*$') THEN try_strptime(replace(trim({v}), 'T', ' '), [{half_formats}]) "
        f"ELSE try_strptime(replace(trim({v}), 'T', ' '), [{formats}]) END END"
    )


def kind(v: str, quoted: str = "FALSE", override: str = "'Auto'") -> str:
    n, d = f"({number(v)})", f"({date(v)})"
    return f"""CASE
      WHEN {quoted} THEN 'text'
      WHEN {override} = 'Text' THEN 'text'
      WHEN {override} = 'Integer' THEN CASE WHEN {n} = floor({n}) AND {n} BETWEEN -2147483648 AND 2147483647 THEN 'integer' ELSE 'text' END
      WHEN {override} = 'Decimal' THEN CASE WHEN {n} IS NOT NULL THEN 'decimal' ELSE 'text' END
      WHEN {override} = 'Date' THEN CASE WHEN {d} IS NOT NULL THEN 'date' ELSE 'text' END
      WHEN {n} IS NOT NULL THEN CASE WHEN {n} = floor({n}) AND abs({n}) < 2147483647 THEN 'integer' ELSE 'decimal' END
      WHEN year({d}) BETWEEN 1900 AND 2100 THEN 'date'
      ELSE 'text' END"""


def field_tokens(line: str, sep: str) -> str:
    """Raw fields with their separators, by the quoting rules."""
    s = {"\t": r"\t", "|": r"\|"}.get(sep, sep)
    quoted = r'"(?:[^"]|"")*(?:"|$)'
    if sep == "":
        pattern = rf"{quoted}|(?s:.+)"
        return f"CASE WHEN {line} = '' THEN [] ELSE regexp_extract_all({line}, {literal(pattern)}) END"
    pattern = rf"{quoted}{s}?|[^{s}]*{s}|[^{s}]+$"
    return (
        f"CASE WHEN {line} = '' THEN [] WHEN ends_with({line}, {sep_literal(sep)}) "
        f"THEN list_append(regexp_extract_all({line}, {literal(pattern)}), '') "
        f"ELSE regexp_extract_all({line}, {literal(pattern)}) END"
    )


def by_separator(build, seps=(",", ";", "\t", "|")) -> str:
    whens = " ".join(f"WHEN separator = {sep_literal(s)} THEN {build(s)}" for s in seps)
    return f"CASE {whens} ELSE {build('')} END"


def tokens(line: str) -> str:
    return by_separator(lambda s: field_tokens(line, s))


def token_value(t: str) -> str:
    inner = rf"""replace(regexp_extract({t}, '^"((?:[^"]|"")*)', 1), '""', '"')"""
    bare = f"CASE WHEN separator <> '' AND ends_with({t}, separator) THEN {t}[:-2] ELSE {t} END"
    return f"CASE WHEN starts_with({t}, '\"') THEN {inner} ELSE {bare} END"


def names(line: str) -> str:
    def build(s: str) -> str:
        return f"[{line}]" if s == "" else f"string_split({line}, {sep_literal(s)})"

    trimmed = rf"regexp_replace(regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g'), '^\"+|\"+$', '', 'g')"
    return f"list_transform({by_separator(build)}, lambda x: {trimmed})"


def is_header(name: str) -> str:
    pattern = "|".join(p for p, _ in DEFAULT_HEADER_PATTERNS)
    return f"regexp_matches(lower(trim({name})), {literal(pattern)})"


def override(name: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower(trim({name})), {literal(p)}) THEN {literal(t)}"
        for p, _, t in DEFAULT_TYPE_OVERRIDES
    )
    return f"CASE {whens} ELSE 'Auto' END"


def text_lines(text: str) -> str:
    """Array of the lines of a text."""
    parts = f"string_split_regex({text}, '\\r\\n|\\r|\\n')"
    return f"CASE WHEN ({parts})[-1] = '' THEN ({parts})[:-2] ELSE {parts} END"


def two_places(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)"


def moment(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
DOUBLES = {
    "o_totalprice", "c_acctbal", "p_retailprice", "s_acctbal", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "value",
}
MOMENTS = {"o_orderdate", "l_shipdate", "ts"}
PRINTED = {"orders": ";", "customer": "|", "part": ",", "supplier": "\t"}


def printed(column: str) -> str:
    if column in DOUBLES:
        return two_places(column)
    if column in MOMENTS:
        return moment(column)
    return f"CAST({column} AS VARCHAR)"


def printed_line(name: str, sep: str) -> str:
    return f"concat_ws({sep_literal(sep)}, {', '.join(printed(c) for c in COLUMNS[name])})"


def checksum(v: str) -> str:
    return f"CAST(sum(CAST('0x' || substr(md5({v}), 1, 8) AS BIGINT)) % {1 << 61} AS BIGINT)"


def half_up_text(x: str) -> str:
    """At most two places, decimal comma."""
    rounded = f"CAST(round(CAST(printf('%.14e', {x}) AS DECIMAL(38,18)), 2) AS DECIMAL(38,2))"
    return rf"replace(regexp_replace(CAST({rounded} AS VARCHAR), '\.?0+$', ''), '.', ',')"


# --- profile of sources given as (path, line_no, line) ------------------------------------


def profile(lines: str, head: int = 100) -> str:
    """CTEs ``profile`` and ``content`` over the first lines of a query that gives path, line_no and line."""
    blank = rf"NOT regexp_matches(line, '[^\t\n\x0B\f\r ]')"
    counts = ", ".join(
        f"coalesce(sum(CASE WHEN start_line > 0 THEN length(line) - length(replace(line, {sep_literal(s)}, '')) END), 0) AS n{i}"
        for i, s in enumerate((",", ";", "\t", "|"))
    )
    return f"""
    lines AS ({lines}),
    sizes AS (SELECT path, count(*) AS total_lines,
                     coalesce(min(CASE WHEN line_no <= {head} AND NOT ({blank}) THEN line_no END), 0) AS start_line
              FROM lines GROUP BY path),
    content AS (SELECT l.*, start_line, total_lines FROM lines l JOIN sizes USING (path)
                WHERE line_no <= {head} AND line_no >= start_line),
    counted AS (SELECT path, start_line, any_value(total_lines) AS total_lines, max(line_no) AS end_line,
                       {counts} FROM content GROUP BY path, start_line),
    chosen AS (SELECT *, greatest(n0, n1, n2, n3) AS best, n0 + n1 + n2 + n3 AS total FROM counted),
    separated AS (SELECT path, start_line, total_lines, end_line,
        CASE WHEN best = 0 THEN '' WHEN n0 = best THEN ',' WHEN n1 = best THEN ';' WHEN n2 = best THEN chr(9) ELSE '|' END AS separator,
        CASE WHEN total > 0 THEN CAST(best AS DOUBLE) / CAST(total AS DOUBLE) * 100 ELSE 0.0 END AS separator_probability
        FROM chosen),
    numbered AS (SELECT c.path, c.line_no, c.line, s.separator,
                        row_number() OVER (PARTITION BY c.path ORDER BY c.line_no) AS rn
                 FROM content c JOIN separated s USING (path) WHERE c.start_line > 0 AND NOT ({blank.replace('line,', 'c.line,')})),
    firsts AS (SELECT path, any_value(separator) AS separator,
                      max(CASE WHEN rn = 1 THEN line END) AS first_line, max(CASE WHEN rn = 2 THEN line END) AS second_line
               FROM numbered WHERE rn <= 2 GROUP BY path),
    named AS (SELECT path, second_line, {names('first_line')} AS n1, {names("coalesce(second_line, '')")} AS n2 FROM firsts),
    headed AS (SELECT path, n1 AS all_names,
        CASE WHEN second_line IS NULL OR len(n2) < len(n1) THEN FALSE
             WHEN len(list_filter(n1, lambda x: {is_header('x')})) > 0 THEN TRUE
             ELSE len(list_filter(range(1, len(n1) + 1), lambda i: ({lenient('n1[i]')}) IS NOT NULL AND ({lenient('n2[i]')}) IS NOT NULL)) = 0
        END AS has_header FROM named),
    fielded AS (SELECT path, line_no, len({tokens('line')}) AS n FROM content JOIN (SELECT path, separator FROM separated) USING (path)),
    fields AS (SELECT path, arg_min(n, line_no) AS field_count, min(n) = max(n) AS is_field_count_equal FROM fielded GROUP BY path),
    profile AS (SELECT s.path, separator, separator_probability, start_line, end_line, end_line AS analyzed_lines, total_lines,
                       CAST(field_count AS INTEGER) AS field_count, is_field_count_equal,
                       coalesce(has_header, FALSE) AS has_header,
                       CASE WHEN has_header THEN all_names END AS names
                FROM separated s JOIN fields USING (path) LEFT JOIN headed USING (path))"""


PROFILE_COLUMNS = (
    "path, separator, separator_probability, start_line, end_line, analyzed_lines, total_lines, "
    "field_count, is_field_count_equal, has_header"
)

DOCUMENT_LINES = f"""SELECT path, CAST(i AS BIGINT) AS line_no, a[i] AS line FROM (
    SELECT path, a, unnest(range(1, len(a) + 1)) AS i FROM (
    SELECT CAST(doc_id AS VARCHAR) AS path, {text_lines('text')} AS a FROM documents))"""

TURN_LINES = DOCUMENT_LINES.replace(
    "CAST(doc_id AS VARCHAR) AS path", "concat_ws('/', conv_id, turn) AS path"
).replace("FROM documents", "FROM conversations")


def _printed_tables() -> str:
    from rowloom.plans.queries import PRINTED as KEYS

    return " UNION ALL ".join(
        f"SELECT '{t}' AS path, row_number() OVER (ORDER BY {KEYS[t][1]}) AS line_no, "
        f"{printed_line(t, sep)} AS line FROM {t}"
        for t, sep in PRINTED.items()
    )


def kinds_per_column(tables: list[str], overrides: bool = False) -> str:
    """Kind counts of every column of some printed tables."""
    cells = " UNION ALL ".join(
        f"SELECT '{t}' AS path, {i} AS col, {printed(c)} AS v, "
        f"{override(literal(c)) if overrides else literal('Auto')} AS o FROM {t}"
        for t in tables
        for i, c in enumerate(COLUMNS[t])
    )
    return counted_kinds(cells, "path, col")


def counted_kinds(cells: str, keys: str) -> str:
    """Kinds per key of a query that gives the keys, a value ``v`` and a type asked for ``o``."""
    return f"""
    WITH cells AS ({cells}),
    typed AS (SELECT {keys}, v, {kind('v', override='o')} AS kind FROM cells),
    counted AS (SELECT {keys}, count(*) AS cells, count(*) FILTER (v = '') AS empty,
      count(*) FILTER (kind = 'text' AND v <> '') AS texts, count(*) FILTER (kind = 'integer') AS integers,
      count(*) FILTER (kind = 'decimal') AS decimals, count(*) FILTER (kind = 'date') AS dates
      FROM typed GROUP BY {keys})
    SELECT *, {ROLL_UP} AS data_type FROM counted"""


ROLL_UP = """CASE WHEN texts > 0 THEN 'text' WHEN dates > 0 AND integers + decimals > 0 THEN 'text'
      WHEN dates > 0 THEN 'date' WHEN decimals > 0 THEN 'decimal' WHEN integers > 0 THEN 'integer' ELSE 'text' END"""


def render(v: str, is_text: bool, sep: str, mode: int) -> str:
    quoted = f"'\"' || replace({v}, '\"', '\"\"') || '\"'"
    if mode == 0:
        return v
    if mode == 2 or is_text:
        return quoted
    return f"CASE WHEN {v} = '' OR contains({v}, {sep_literal(sep)}) OR contains({v}, '\"') THEN {quoted} ELSE {v} END"


def letters(i: str) -> str:
    return (
        f"CASE WHEN {i} >= 702 THEN chr(CAST(65 + (({i} - 702) // 676) % 26 AS INTEGER)) ELSE '' END || "
        f"CASE WHEN {i} >= 26 THEN chr(CAST(65 + (({i} - 26) // 26) % 26 AS INTEGER)) ELSE '' END || "
        f"chr(CAST(65 + {i} % 26 AS INTEGER))"
    )


def serial(x: str) -> str:
    days = f"date_diff('day', DATE '1899-12-30', CAST({x} AS DATE))"
    part = f"CAST((hour({x}) * 3600 + minute({x}) * 60) * 1000000 + microsecond({x}) AS DOUBLE) / 86400000000.0::DOUBLE"
    return f"{days} + {part}"


# --- the queries -------------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["separator_profile"] = f"WITH {profile(_printed_tables())} SELECT {PROFILE_COLUMNS} FROM profile"
    sql["document_line_profile"] = (
        f"WITH {profile(DOCUMENT_LINES)} SELECT {PROFILE_COLUMNS}, "
        "coalesce(array_to_string(names, '|'), '') AS header_names FROM profile"
    )
    sql["full_line_profile"] = (
        f"WITH {profile(DOCUMENT_LINES, 2**62)} SELECT {PROFILE_COLUMNS}, "
        "coalesce(array_to_string(names, '|'), '') AS header_names FROM profile"
    )
    sql["header_detect"] = (
        f"WITH {profile(TURN_LINES)} SELECT path, has_header, "
        "coalesce(array_to_string(names, '|'), '') AS header_names, "
        f"coalesce(array_to_string(list_transform(names, lambda x: {override('x')}), '|'), '') AS overrides FROM profile"
    )
    content = r"regexp_matches(line, '[^\t\n\x0B\f\r ]')"
    sql["blank_lines"] = f"""
      SELECT path, count(*) AS lines, count(*) FILTER ({content}) AS content_lines,
             min(line_no) FILTER ({content}) AS first_content, max(line_no) FILTER ({content}) AS last_content
      FROM ({DOCUMENT_LINES}) GROUP BY path"""
    sql["line_numbering"] = """
      SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no FROM events"""

    quoted_line = "concat_ws(';', " + ", ".join(
        render(printed(c), True, ";", 2) for c in COLUMNS["events"]
    ) + ")"
    sql["field_count_consistency"] = f"""
      WITH lines AS (SELECT 'bare' AS path, {printed_line('events', ';')} AS line FROM events
                     UNION ALL SELECT 'quoted', {quoted_line} FROM events),
      fields AS (SELECT path, {field_tokens('line', ';')} AS f FROM lines),
      sized AS (SELECT path, len(f) AS n, len(list_filter(f, lambda x: starts_with(x, '"'))) AS q FROM fields)
      SELECT path, count(*) AS lines, CAST(min(n) AS INTEGER) AS least, CAST(max(n) AS INTEGER) AS most, min(n) = max(n) AS is_field_count_equal,
             CAST(sum(q) AS BIGINT) AS quoted_fields FROM sized GROUP BY path"""
    sql["split_documents"] = f"""
      WITH {profile(DOCUMENT_LINES)},
      raw AS (SELECT path, separator, unnest({tokens('line')}) AS t FROM lines JOIN (SELECT path, separator FROM separated) USING (path)),
      vals AS (SELECT path, starts_with(t, '"') AS q, {token_value('t')} AS v FROM raw)
      SELECT path, count(*) AS fields, count(*) FILTER (q) AS quoted_fields, CAST(sum(length(v)) AS BIGINT) AS chars,
             {checksum('v')} AS checksum FROM vals GROUP BY path"""
    event_texts = ", ".join(f"{printed(c)} AS {c}" for c in COLUMNS["events"])
    sql["split_roundtrip"] = " UNION ALL ".join(f"SELECT {m} AS mode, {event_texts} FROM events" for m in (1, 2))

    sql["cell_kinds"] = kinds_per_column(["lineitem"])
    sql["override_kinds"] = kinds_per_column(["lineitem"], overrides=True)
    sql["column_type_report"] = (
        "SELECT *, round(empty / cells, 6) AS null_rate FROM (" + kinds_per_column(list(PRINTED)) + ")"
    )
    order_names = ", ".join(f"({i}, {literal(c)})" for i, c in enumerate(COLUMNS["orders"]))
    sql["typed_columns"] = (
        "SELECT name, t.* FROM (" + kinds_per_column(["orders"], overrides=True)
        + f") t JOIN (VALUES {order_names}) n(i, name) ON t.col = n.i"
    )
    style = "CASE kind WHEN 'date' THEN 1 WHEN 'decimal' THEN 2 WHEN 'integer' THEN 3 ELSE 0 END"
    sql["document_cells"] = f"""
      WITH {profile(DOCUMENT_LINES)},
      raw AS (SELECT l.path, l.line_no - greatest(p.start_line, 1) + 1 AS row, separator, names, {tokens('line')} AS ts
              FROM lines l JOIN profile p USING (path) WHERE l.line_no >= p.start_line),
      one AS (SELECT path, row, separator, names, ts, unnest(range(1, len(ts) + 1)) AS i FROM raw),
      vals AS (SELECT path, row, i - 1 AS col, starts_with(ts[i], '"') AS q, {token_value('ts[i]')} AS v,
                      CASE WHEN i <= len(names) THEN {override('names[i]')} ELSE 'Auto' END AS o FROM one),
      typed AS (SELECT path, row, col, v, {kind('v', 'q', 'o')} AS kind FROM vals)
      SELECT path, max(row) AS last_row, count(*) AS cells, count(*) FILTER (kind = 'text') AS texts,
             count(*) FILTER (kind = 'integer') AS integers, count(*) FILTER (kind = 'decimal') AS decimals,
             count(*) FILTER (kind = 'date') AS dates,
             {checksum(f"concat_ws(':', ({letters('col')}) || row, {style}, v)")} AS checksum
      FROM typed GROUP BY path"""
    sql["unlike_sources"] = " UNION ALL ".join(
        f"SELECT '{t}' AS path, count(*) AS rows, CAST(sum({k}) AS BIGINT) AS keys, CAST(sum(CAST(round({a} * 100) AS BIGINT)) AS BIGINT) AS cents, "
        f"CAST(sum({d}) AS BIGINT) AS days, {checksum(n)} AS names, CAST(0 AS BIGINT) AS rescued FROM {t}"
        for t, k, a, d, n in (
            ("orders", "o_orderkey", "o_totalprice", "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))", "o_orderpriority"),
            ("customer", "c_custkey", "c_acctbal", "NULL::BIGINT", "c_name"),
            ("part", "p_partkey", "p_retailprice", "NULL::BIGINT", "p_name"),
            ("supplier", "s_suppkey", "s_acctbal", "NULL::BIGINT", "s_name"),
        )
    )
    sql["typed_table"] = """
      SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, TRUE AS complete FROM customer"""
    words = "SELECT unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS name FROM {}"
    sql["name_rules"] = f"""
      WITH words AS ({words.format('documents')}),
      counted AS (SELECT name, count(*) AS n FROM words WHERE name <> '' GROUP BY name),
      ruled AS (SELECT name, n, {is_header('name')} AS is_header, {override('name')} AS data_type FROM counted)
      SELECT data_type, is_header, count(*) AS names, CAST(sum(n) AS BIGINT) AS words, {checksum('name')} AS checksum
      FROM ruled GROUP BY data_type, is_header"""
    sql["rule_join"] = f"""
      SELECT DISTINCT name, {override('name')} AS data_type FROM ({words.format('conversations')}) WHERE name <> ''"""

    charge = "l_extendedprice * (1 - l_discount)"
    sql["german_numbers"] = f"""
      SELECT l_returnflag, count(*) AS prices, count(*) FILTER (l_extendedprice = floor(l_extendedprice)) AS whole,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total,
             {checksum(half_up_text('l_extendedprice'))} AS exported,
             {checksum(f"replace({half_up_text('l_extendedprice')}, ',', '.')")} AS stored,
             {checksum(half_up_text(charge))} AS charges
      FROM lineitem GROUP BY l_returnflag"""
    plain = two_places("p_retailprice")
    thousands = rf"regexp_replace({plain}, '([0-9])([0-9]{{3}}\.)', '\1,\2')"
    sql["lenient_numbers"] = f"""
      WITH shown AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN {plain} WHEN 1 THEN {thousands}
          WHEN 2 THEN '(' || {plain} || ')' WHEN 3 THEN {plain} || '-' WHEN 4 THEN ' ¤' || {plain} || ' '
          ELSE {plain} || 'e1' END AS text, p_retailprice AS price,
          CAST({plain} || 'e1' AS DOUBLE) AS tenfold, p_partkey % 6 AS k FROM part),
      valued AS (SELECT p_partkey, text, CASE WHEN k IN (2, 3) THEN -price WHEN k = 5 THEN tenfold ELSE price END AS lenient,
          CASE WHEN k = 0 OR (k = 1 AND price < 1000) THEN price WHEN k = 5 THEN tenfold END AS strict FROM shown)
      SELECT *, CASE WHEN strict = floor(strict) THEN CAST(strict AS INTEGER) END AS as_integer FROM valued"""
    sql["date_formats"] = f"""
      SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
               WHEN 1 THEN strftime(o_orderdate, '%-d.%-m.%Y') ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M') END AS text,
             'date' AS kind, CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS serial,
             strftime(o_orderdate, '%Y-%m-%d') AS back,
             CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d')
                  WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') END AS month_first,
             'dd.mm.yyyy' AS format FROM orders"""
    sql["serial_dates"] = f"""
      SELECT event_id, {serial('ts')} AS serial, strftime(ts, '%Y-%m-%d') AS day FROM events"""
    sql["quote_modes"] = " UNION ALL ".join(
        f"SELECT event_id, {literal(sep)} AS separator, {mode} AS mode, "
        f"{render('event_type', True, sep, mode)} || {literal(sep)} || {render(printed('value'), False, sep, mode)} || "
        f"{literal(sep)} || {render('props', True, sep, mode)} AS line FROM events"
        for sep in (";", ",")
        for mode in (0, 1, 2)
    )

    sql["cell_refs"] = f"""
      WITH placed AS (SELECT DISTINCT CAST((l_partkey * 8 + l_linenumber) % 16384 AS INTEGER) AS col, l_suppkey + 1 AS row FROM lineitem)
      SELECT col, row, {letters('col')} AS letters, ({letters('col')}) || row AS ref, col AS back FROM placed"""
    sql["densify_cells"] = f"""
      SELECT o_orderstatus AS path, o_orderkey AS row,
        concat_ws(';', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), '"' || o_orderstatus || '"',
          CASE WHEN o_totalprice >= 100000 THEN {two_places('o_totalprice')}
               WHEN o_orderstatus <> 'F' OR o_orderpriority <> '4-NOT SPECIFIED' THEN '""' END,
          CASE WHEN o_orderstatus <> 'F' THEN {moment('o_orderdate')}
               WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN '""' END,
          CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN '"' || o_orderpriority || '"' END) AS line
      FROM orders"""
    stored = [
        ("'text'", "o_orderpriority"),
        ("'text'", "o_orderstatus"),
        ("'number'", half_up_text("o_totalprice")),
        ("'date'", "strftime(o_orderdate, '%Y-%m-%d')"),
        ("'boolean'", "CASE WHEN o_totalprice > 250000 THEN 'TRUE' ELSE 'FALSE' END"),
        ("'number'", "CAST(o_custkey AS VARCHAR)"),
    ]
    sql["shared_string_cells"] = " UNION ALL ".join(
        f"SELECT 'Orders' AS sheet, o_orderkey + 1 AS row, '{chr(65 + i)}' || (o_orderkey + 1) AS ref, {i} AS col, "
        f"{k} AS kind, {v} AS text FROM orders"
        for i, (k, v) in enumerate(stored)
    )

    customer_cells = [
        ("'number'", "CAST(c_custkey AS VARCHAR)", "3"),
        ("'text'", "c_name", "0"),
        ("'number'", "CAST(c_nationkey AS VARCHAR)", "3"),
        ("'number'", half_up_text("c_acctbal"), "CASE WHEN c_acctbal = floor(c_acctbal) THEN 3 ELSE 2 END"),
        ("'text'", "c_mktsegment", "0"),
    ]
    numbered = (
        "(SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row FROM customer)"
    )
    sql["workbook_roundtrip"] = " UNION ALL ".join(
        f"SELECT 'nation-' || c_nationkey AS path, 'Tabelle1' AS sheet, row, {i} AS col, '{chr(65 + i)}' || row AS ref, "
        f"{k} AS kind, {v} AS text, {s} AS style FROM {numbered}"
        for i, (k, v, s) in enumerate(customer_cells)
    )
    line = " || ';' || ".join(
        f"'\"' || {v} || '\"'" if k == "'text'" else v for k, v, _ in customer_cells
    )
    sql["workbook_lines"] = (
        f"SELECT 'nation-' || c_nationkey || '#' || ((row - 1) // 40) AS path, (row - 1) % 40 + 1 AS row, {line} AS line FROM {numbered}"
    )
    invalid = r'[<>:"/\\|?*\x00-\x1F ]'
    base = r"regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '')"
    sql["sheet_paths"] = rf"""
      WITH p AS (SELECT page_id, url AS full, regexp_replace(url, '\?.*', '') AS url FROM pages),
      q AS (SELECT page_id, regexp_replace("full", {literal(invalid)}, '_', 'g') AS sheet, url,
                   regexp_replace(regexp_extract(url || '.xlsx', '([^/]*)$', 1), '\.[^.]*$', '') AS base,
                   regexp_extract(url, '^(.*/)?', 1) AS folder FROM p)
      SELECT page_id, sheet, base, '.xlsx' AS extension, folder || base || '.csv' AS next_to_source,
             '/out/' || base || '.xlsx' AS in_folder, folder || base || '_' || sheet || '.csv' AS per_sheet FROM q"""
    del base
    sql["output_names"] = """
      WITH taken AS (SELECT p_name, max(p_size) AS top FROM part GROUP BY p_name),
      asked AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part),
      numbers AS (SELECT p_name, i FROM taken, unnest(range(0, (SELECT count(*) + 3 FROM part))) AS u(i)
                  WHERE i NOT IN (0, 2) AND i <> top),
      free AS (SELECT p_name, i, row_number() OVER (PARTITION BY p_name ORDER BY i) AS k FROM numbers)
      SELECT p_partkey, a.p_name || '_' || i || '.xlsx' AS name FROM asked a JOIN free f ON a.p_name = f.p_name AND a.k = f.k"""
    sql["sheet_rows"] = """
      WITH odd AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0)
      SELECT 'Odd' AS sheet, o_orderkey + 1 AS row, 'A' || (o_orderkey + 1) AS ref, 'number' AS kind, CAST(o_custkey AS VARCHAR) AS text FROM odd
      UNION ALL SELECT 'Odd', o_orderkey + 1, 'B' || (o_orderkey + 1), CASE WHEN o_orderkey % 3 = 0 THEN 'empty' ELSE 'text' END,
             CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END FROM odd"""
    sql["file_rules"] = sql["name_rules"]
    sql["charset_files"] = f"""
      WITH lines AS ({DOCUMENT_LINES})
      SELECT charset, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, {checksum('line')} AS checksum
      FROM lines, (VALUES ('UTF-8'), ('windows-1252'), ('ISO-8859-1'), ('ISO-8859-15'),
        ('UTF-16LE'), ('UTF-16BE')) c(charset) GROUP BY charset"""
    sql["line_file_numbers"] = f"""
      SELECT event_type, count(*) AS lines, CAST(sum(event_id) AS BIGINT) AS ids, count(*) AS numbers,
             {checksum(f"concat_ws(';', event_id, user_id, {two_places('value')})")} AS checksum
      FROM events GROUP BY event_type"""
    sql["file_profiles"] = """
      SELECT c_mktsegment AS segment, '.txt' AS extension, 'UTF-8' AS encoding, '|' AS separator,
             100.0::DOUBLE AS separator_probability, CAST(1 AS BIGINT) AS start_line, count(*) AS total_lines, 5 AS field_count,
             TRUE AS is_field_count_equal FROM customer GROUP BY c_mktsegment"""
    per_status = " UNION ALL ".join(
        f"SELECT o_orderstatus AS path, {i} AS col, {printed(c)} AS v, 'Auto' AS o FROM orders"
        for i, c in enumerate(COLUMNS["orders"])
    )
    sql["file_cells"] = counted_kinds(per_status, "path, col")
    dropped = " UNION ALL ".join(
        f"SELECT {i} AS col, {printed(c)} AS v, 'Auto' AS o FROM events{again}"
        for i, c in enumerate(["event_id", "event_type", "value", "ts"])
        for again in ("", " WHERE event_type = 'click'")
    )
    sql["file_stream"] = counted_kinds(dropped, "col")
    supplier_cells = " UNION ALL ".join(f"SELECT {printed(c)} AS v FROM supplier" for c in COLUMNS["supplier"])
    nation_cells = " UNION ALL ".join(f"SELECT {printed(c)} AS v FROM nation" for c in COLUMNS["nation"])
    amounts = " UNION ALL ".join(
        [f"SELECT {c} AS v FROM supplier" for c in ("s_suppkey", "s_nationkey", "s_acctbal", "NULL")]
        + [f"SELECT {c} AS v FROM nation" for c in ("n_nationkey", "NULL", "n_regionkey")]
    )
    sql["batch_conversion"] = f"""
      SELECT 'cells' AS output, count(*) AS items, {checksum('v')} AS checksum FROM ({supplier_cells})
      UNION ALL SELECT 'hidden cells', count(*), {checksum('v')} FROM ({nation_cells})
      UNION ALL SELECT 'lines', count(*), {checksum('line')} FROM (SELECT {line} AS line FROM customer)
      UNION ALL SELECT 'lines of files', count(*), {checksum('line')} FROM (SELECT {line} AS line FROM customer)
      UNION ALL SELECT 'cells of files', count(*), CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) FROM ({amounts})
      UNION ALL SELECT 'failed', 2, 0"""
    sql["stream_report"] = """
      SELECT 'ok' AS status, CAST(1 AS BIGINT) AS times, (SELECT count(*) FROM pages) + (SELECT count(*) FROM nation) AS lines,
             CAST(2 AS BIGINT) AS hard_files
      UNION ALL SELECT 'failed', 1, 0, 1"""
    return sql
