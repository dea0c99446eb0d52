"""Plain Python statements of the rules, for small random cases only."""

import math
import re

from docfields.fixed import ALNUM_WORD, LETTERS as LETTERS_PATTERN, NUMBER, SERIAL_TAIL, SNIPPET_WIDTH

SHAPES = [re.compile(p) for p in (NUMBER, rf"\b{ALNUM_WORD}\b", LETTERS_PATTERN)]


def search(text, term, patterns):
    """A field's first pattern that matches decides; without one, the first shape after the literal term."""
    tried = (re.search(regex, text, re.I | re.S) for regex in patterns.get(term.lower(), []))
    field = next(filter(None, tried), None)
    if field:
        return term, (field[1] or "").strip()
    label = re.search(re.escape(term), text, re.I)
    if not label:
        return None, None
    near = text[label.end():].lstrip(" \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0:=-")[:SNIPPET_WIDTH]
    values = (shape.search(near) for shape in SHAPES)
    return label[0], next((v[0] for v in values if v), None)


def chain(text, term, n, patterns):
    """Hops while both key and value are found: each looks for the value of the one before."""
    key, value = search(text, term, patterns)
    if not (key and value):
        return []
    return [(key, value)] + (chain(text, value, n - 1, patterns) if n > 1 else [])


def serials(text, cues):
    return [
        [m.group(1) for m in re.finditer(re.escape(cue) + SERIAL_TAIL, text, re.I)]
        for cue in cues
    ]


def number(value):
    bare = value.replace(" ", "")
    bare = bare.replace(",", "") if "." in bare else bare.replace(",", ".")
    numeric = re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", bare.strip())
    return (float(bare), None) if numeric and math.isfinite(float(bare)) else (None, bare)


def text_tables(text, flavor):
    """`[(header, rows)]` of one layout."""
    found, run = [], []
    for line in [*text.split("\n"), ""]:
        if flavor == "stream":
            cells = re.split(" {2,}", line.strip(" "))
        else:
            inner = re.sub(r"^ *\||\| *$", "", line)
            cells = [c.strip(" ") for c in inner.split("|")]
        if len(cells) > 1:
            run.append(cells)
        elif run:
            found.append((run[0], run[1:]))
            run = []
    return found


def without_repeats(tables, sample=None):
    kept, seen = [], set()
    for header, rows in tables:
        tidy = tuple(tuple(" ".join(c.split()).lower() for c in row) for row in rows[:sample])
        mark = tuple(h.strip().lower() for h in header), tidy
        if mark not in seen:
            seen.add(mark)
            kept.append((header, rows))
    return kept


def lookup(flavors, term, known):
    """Values of a term: `flavors` is a list of lists of `(header, rows)`."""
    term = term.lower()
    for tables in flavors:
        for header, rows in without_repeats(tables):
            for i, name in enumerate(header):
                if term in name.lower():
                    column = [r[i] for r in rows if i < len(r) and r[i] and r[i] not in known]
                    if column:
                        return list(dict.fromkeys(column))
            for cell in (c for row in rows for c in row):
                if cell and term in cell.lower() and cell not in known:
                    return [cell]
    return []


def extract(pages, terms, patterns, n=0, trace=False, flavors=None, tables=None):
    """Results as `(image, key, value, path)`; tables from the text or from `tables[page]`."""
    out = []
    for page, text in pages:
        recorded = []
        for pos, term in enumerate(terms):
            hops = chain(text, term, n, patterns)
            if hops:
                key = hops[-1][0] if trace else (term if n else hops[0][0])
                path = " -> ".join(f"{k}:{v}" for k, v in hops) if trace else None
                recorded.append((key.strip().lower(), hops[-1][1], path))
            if term.lower() in [t.lower() for t in terms[:pos]] or (hops and not trace):
                continue
            known = {v for k, v, _ in recorded if k == term.lower()}
            source = tables[page] if tables else [text_tables(text, f) for f in flavors or ()]
            recorded += [(term.lower(), v, None) for v in lookup(source, term, known)]
        out += [(page, *r) for r in recorded]
    return out


def aligned_tables(text):
    """`[(header, rows)]` of tables whose columns line up."""
    out, run = [], []
    for line in [*re.split("\r?\n", text.replace("\0", "")), ""]:
        if re.search("[^ ] {2,}[^ ]", line):
            run.append(line.rstrip(" "))
            continue
        if len(run) >= 3:
            width = max(map(len, run))
            padded = [x.ljust(width) for x in run]
            gap = [all(x[p] == " " for x in padded) for p in range(width)]
            starts = [p for p in range(width) if not gap[p] and (p == 0 or gap[p - 1])]
            starts = [p for i, p in enumerate(starts) if i == 0 or any(
                len(x) > p and (x[p - 2:p] == "  " or x[p] == " ") for x in run)]
            if len(starts) > 1:
                rows = [[x[a:b].strip(" ") for a, b in zip(starts, [*starts[1:], None])] for x in run]
                out.append((rows[0], rows[1:]))
        run = []
    return out
