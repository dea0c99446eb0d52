"""Pieces of DuckDB SQL that state the search rules independently, by regular expressions."""

import re

from docfields.fixed import DATE, LETTERS, NUMBER, SERIAL_CUES, SERIAL_TAIL

WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
WORD = r"(?:^|[^\p{L}\p{N}_])([A-Za-z0-9]+)(?:$|[^\p{L}\p{N}_])"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern(term: str, tail: str = "") -> str:
    return quote("(?is)" + re.escape(term).replace(r"\ ", " ") + tail)


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def field_first(text: str, regexes: list[str]) -> str:
    each = [strip(f"regexp_extract_all({text}, {quote('(?is)' + r)}, 1)[1]") for r in regexes]
    return f"coalesce({', '.join(each)})" if each else "cast(null as varchar)"


def field_all(text: str, regexes: list[str]) -> str:
    return " || ".join(f"regexp_extract_all({text}, {quote('(?is)' + r)}, 1)" for r in regexes)


def _at(text: str, term: str) -> str:
    return f"nullif(instr(lower({text}), lower({term})), 0)"


def found(text: str, term: str, column: bool = False) -> str:
    """For a term from a column by position, since a pattern would be compiled for every row."""
    if column:
        return f"substr({text}, {_at(text, term)}, length({term}))"
    return f"nullif(regexp_extract({text}, {_pattern(term)}), '')"


def snippet(text: str, term: str, column: bool = False) -> str:
    if column:
        return f"left(ltrim(substr({text}, {_at(text, term)} + length({term})), {WS} || ':=-'), 100)"
    after = _pattern(term, r"[\s:=-]*(.{0,100})")
    return f"regexp_extract_all({text}, {after}, 1)[1]"


def cascade(s: str) -> str:
    return (f"coalesce(nullif(regexp_extract({s}, {quote(NUMBER)}), ''), "
            f"nullif(regexp_extract({s}, {quote(WORD)}, 1), ''), "
            f"nullif(regexp_extract({s}, {quote(LETTERS)}), ''))")


def by_pattern(text: str, term: str, patterns: dict, column: bool = False) -> str:
    if not column:
        return field_first(text, patterns.get(term.lower(), []))
    cases = " ".join(
        f"when {quote(f)} then {field_first(text, r)}" for f, r in patterns.items()
    )
    return f"case lower({term}) {cases} end" if cases else "cast(null as varchar)"


def search(text: str, term: str, patterns: dict, column: bool = False) -> tuple[str, str]:
    """SQL for key and value of one search."""
    pat = by_pattern(text, term, patterns, column)
    name = term if column else quote(term)
    key = f"case when {pat} is not null then {name} else {found(text, term, column)} end"
    return key, f"coalesce({pat}, {cascade(snippet(text, term, column))})"


def searches(pages: str, terms: list[str], patterns: dict) -> str:
    """One SELECT per term: `page_id, term_pos, term, key, value`, as found."""
    parts = []
    for pos, term in enumerate(terms):
        key, value = search("text", term, patterns)
        parts.append(f"select page_id, {pos} as term_pos, {quote(term)} as term, "
                     f"{key} as key, {value} as value from {pages}")
    return "\n union all ".join(parts)


def date_near(text: str, term: str) -> str:
    regex = _pattern(term, rf"[\s:=-]*({DATE})")
    return f"regexp_extract_all({text}, {regex}, 1)[1]"


def _cues(text: str) -> list[str]:
    return [f"regexp_extract_all({text}, {_pattern(cue, SERIAL_TAIL)}, 1)" for cue in SERIAL_CUES]


def serial_first(text: str, overrides: tuple[str, ...] = ()) -> str:
    own = [f"regexp_extract_all({text}, {quote('(?i)' + r)}, 1)" for r in overrides]
    return "coalesce(" + ", ".join(f"{c}[1]" for c in own + _cues(text)) + ")"


def serial_all(text: str) -> str:
    return " || ".join(_cues(text))


def chains(pages: str, terms: list[str], patterns: dict, n: int) -> str:
    """Common table expressions `h1 … hn`, each with the hops so far, and `chains` with all of them.

    `chains` has `page_id, term_pos, initial, term, value, path` of the last hop reached. Hops hold no text; the page is
    joined to each of them. A chain that ends carries the hop's number, so the last one is a maximum.
    """
    first = "\n union all ".join(
        "select page_id, {pos} as term_pos, {q} as initial, {key} as term, {value} as value from chain_pages"
        .format(pos=pos, q=quote(t), key=k, value=v)
        for pos, t in enumerate(terms) for k, v in [search("text", t, patterns)]
    )
    alive = "term is not null and term <> '' and value is not null and value <> ''"
    ctes = [f"chain_pages as materialized (select page_id, text from {pages})",
            f"s1 as materialized ({first})",
            f"h1 as materialized (select *, concat(term, ':', value) as path from s1 where {alive})"]
    for i in range(2, n + 1):
        key, value = search("text", "last", patterns, column=True)
        ctes.append(f"s{i} as materialized (select page_id, term_pos, initial, {key} as term, {value} as value, before "
                    f"from (select h.page_id, p.text, h.term_pos, h.initial, h.value as last, h.path as before "
                    f"from h{i - 1} h join chain_pages p on p.page_id = h.page_id))")
        ctes.append(f"h{i} as materialized (select page_id, term_pos, initial, term, value, "
                    f"concat(before, ' -> ', term, ':', value) as path from s{i} where {alive})")
    every = "\n union all ".join(f"select {i} as hop, page_id, term_pos, initial, term, value, path from h{i}"
                                 for i in range(1, n + 1))
    ctes.append(f"hops as materialized ({every})")
    return ",\n".join(ctes) + """,
chains as materialized (
  select page_id, term_pos, initial, term, value, path
  from (select *, max(hop) over (partition by page_id, term_pos) as last_hop from hops) where hop = last_hop)"""


def plain_number(expr: str) -> str:
    bare = f"replace({expr}, ' ', '')"
    return (f"case when contains({bare}, ',') and contains({bare}, '.') then replace({bare}, ',', '') "
            f"else replace({bare}, ',', '.') end")


def number(plain: str, number_type: str) -> str:
    numeric = quote(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
    return (f"case when regexp_full_match({strip(plain)}, {numeric}) "
            f"then try_cast({strip(plain)} as {number_type}) end")


def text_cells(pages: str, flavor: str, name: str) -> str:
    """Common table expression `name` with the cells of the tables in the text of `pages`."""
    if flavor == "aligned":
        return aligned_cells(pages, name)
    bars = r"regexp_replace(line, '^ *\||\| *$', '', 'g')"
    if flavor == "stream":
        is_row, cells = "regexp_matches(line, '[^ ] {2,}[^ ]')", "string_split_regex(trim(line, ' '), ' {2,}')"
    else:
        is_row = f"contains(line, '|') and contains({bars}, '|')"
        cells = f"[trim(c, ' ') for c in string_split({bars}, '|')]"
    rank = {"lattice": 0, "stream": 1}[flavor]
    return f"""{name}_lines as materialized (
  select page_id, unnest(lines) as line, unnest(range(0, len(lines))) as line_no
  from (select page_id, string_split_regex(text, '\\r?\\n') as lines from {pages})),
{name}_runs as (
  select page_id, {cells} as cells, line_no,
         line_no - row_number() over (partition by page_id order by line_no) as run
  from {name}_lines where {is_row}),
{name}_rows as materialized (
  select page_id, cells, dense_rank() over (partition by page_id order by run) - 1 as table_idx,
         row_number() over (partition by page_id, run order by line_no) - 2 as row_idx,
         first_value(cells) over (partition by page_id, run order by line_no) as names
  from {name}_runs),
{name} as materialized (
  select page_id, '{flavor}' as flavor, {rank} as flavor_rank, table_idx, row_idx, col_idx,
         names[col_idx + 1] as header, cells[col_idx + 1] as cell
  from (select *, unnest(range(0, greatest(len(names), len(cells)))) as col_idx from {name}_rows where row_idx >= 0))"""


def aligned_cells(pages: str, name: str) -> str:
    """The same for tables whose columns line up: what each place of a run of lines holds, place by place."""
    return f"""{name}_lines as materialized (
  select page_id, unnest(lines) as line, unnest(range(0, len(lines))) as line_no
  from (select page_id, string_split_regex(text, '\\r?\\n') as lines from {pages})),
{name}_runs as (
  select page_id, rtrim(line, ' ') as line, line_no,
         line_no - row_number() over (partition by page_id order by line_no) as run
  from {name}_lines where regexp_matches(line, '[^ ] {{2,}}[^ ]')),
{name}_blocks as materialized (
  select page_id, run, list(line order by line_no) as lines, max(len(line)) as width from {name}_runs group by all having count(*) >= 3),
{name}_places as (
  select page_id, run, p, len(list_filter(lines, lambda x: trim(substr(x, p + 1, 1), ' ') <> '')) = 0 as gap,
         len(list_filter(lines, lambda x: len(x) > p and substr(x, p, 1) = ' ' and p >= 1
                                          and ((p >= 2 and substr(x, p - 1, 1) = ' ') or substr(x, p + 1, 1) = ' '))) > 0 as wide
  from (select *, unnest(range(0, width)) as p from {name}_blocks)),
{name}_firsts as (
  select page_id, run, p, wide, row_number() over (partition by page_id, run order by p) as nr
  from (select *, coalesce(lag(gap) over (partition by page_id, run order by p), true) as before from {name}_places)
  where not gap and before),
{name}_starts as (
  select page_id, run, list(p order by p) as starts from {name}_firsts where nr = 1 or wide group by all having count(*) >= 2),
{name}_rows as materialized (
  select page_id, dense_rank() over (partition by page_id order by run) - 1 as table_idx, unnest(range(-1, len(lines) - 1)) as row_idx,
         unnest(lines) as line, lines[1] as top, starts
  from {name}_blocks join {name}_starts using (page_id, run)),
{name} as materialized (
  select page_id, 'aligned' as flavor, 2 as flavor_rank, table_idx, row_idx, col_idx,
         trim(substr(top, starts[col_idx + 1] + 1, coalesce(starts[col_idx + 2], 100000) - starts[col_idx + 1]), ' ') as header,
         trim(substr(line, starts[col_idx + 1] + 1, coalesce(starts[col_idx + 2], 100000) - starts[col_idx + 1]), ' ') as cell
  from (select *, unnest(range(0, len(starts))) as col_idx from {name}_rows where row_idx >= 0))"""


NORM_HEADER = f"lower({strip("coalesce(header, '')")})"
NORM_CELL = "lower(trim(regexp_replace(coalesce(cell, ''), '\\s+', ' ', 'g'), ' '))"


def lookup(cells: str, terms: list[str] | str, pairs: str | None = None, known: str | None = None) -> str:
    """Common table expressions ending in `lookup(page_id, term_pos, term, value)`; `terms` may be a SELECT of `term_pos, term`."""
    names = terms if isinstance(terms, str) else "values " + ", ".join(f"({i}, {quote(t.lower())})" for i, t in enumerate(terms))
    pair_join = f" join {pairs} p using (page_id, term_pos)" if pairs else ""
    skip = (f" where not exists (select 1 from {known} k where k.page_id = a.page_id and k.key = a.term "
            "and k.value = a.cell and k.term_pos <= a.term_pos)") if known else ""
    return f"""names(term_pos, term) as ({names}),
printed as (
  select page_id, flavor, flavor_rank, table_idx,
         string_agg(concat(row_idx, chr(1), col_idx, chr(1), {NORM_HEADER}, chr(1), {NORM_CELL}), chr(2)
                    order by row_idx, col_idx, {NORM_HEADER}, {NORM_CELL}) as print
  from {cells} group by all),
kept as (
  select page_id, flavor, flavor_rank, table_idx from printed
  qualify row_number() over (partition by page_id, flavor, print order by table_idx) = 1),
kept_cells as (select c.* from {cells} c join kept using (page_id, flavor, flavor_rank, table_idx)),
options as (
  select page_id, term_pos, term, flavor_rank, table_idx, 0 as kind, col_idx as col, row_idx, col_idx, cell
  from kept_cells, names where cell <> '' and contains(lower(header), term)
  union all
  select page_id, term_pos, term, flavor_rank, table_idx, 1 as kind, 0 as col, row_idx, col_idx, cell
  from kept_cells, names where cell <> '' and contains(lower(cell), term)),
allowed as (select a.* from options a{skip}),
ranked as (
  select a.*, rank() over (partition by page_id, term_pos order by flavor_rank, table_idx, kind, col) as r
  from allowed a{pair_join}),
numbered as (
  select *, row_number() over (partition by page_id, term_pos order by row_idx, col_idx, cell) as nr
  from ranked where r = 1),
lookup as (
  select distinct page_id, term_pos, term, cell as value from numbered where kind = 0 or nr = 1)"""
