"""Template mining of log lines: typed tokens, LCS templates, slot roles.

Lines are reduced in the JVM, map-side, to forms in which numbers, ids and runs of
small words look alike; the forms (a fifth of the lines where messages vary
much) are counted, and masked to strings over a small alphabet: what kind of
token stands where. What is left are some hundred shapes. They are clustered by
their longest common subsequence, first per partition of shapes, then the
partition templates are merged the same way; slots are classified by token type
and surroundings into time, level and component. What comes out is a short list
of layouts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token kinds. Times differ by format, the rest by role.
TIMES = {
    "\ue001": r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",
    "\ue002": r"\d{4}/\d\d/\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",
    "\ue003": r"\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d(?: [+-]\d{4})?",
    "\ue004": r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d{1,2} \d\d:\d\d:\d\d(?:\.\d+)?",
    "\ue005": r"\d{4} \d\d:\d\d:\d\d\.\d+",
    "\ue006": r"1\d{12}",
    "\ue007": r"1\d{9}(?:\.\d+)?",
    "\ue008": r"\d\d:\d\d:\d\d(?:[.,]\d+)?",
}
ISO, SLASH, CLF, BSD, COMPACT, MILLIS, SECONDS, CLOCK = TIMES
LEVEL, DOTTED, IDENT, NUMBER, WORD, ADDRESS, ZONE = "\ue010\ue011\ue012\ue013\ue014\ue015\ue016"
JKEY0, JKEY1, FKEY0, FKEY1 = "\ue020\ue021\ue022\ue023"
FREE = {WORD, NUMBER, IDENT, ADDRESS}
GAP = "*"

# The level words programs write and what each stands for.
LEVELS = {
    "trace": "trace", "trc": "trace", "verbose": "trace", "vrb": "trace", "finest": "trace", "t": "trace", "v": "trace",
    "debug": "debug", "dbg": "debug", "dbug": "debug", "fine": "debug", "d": "debug",
    "info": "info", "inf": "info", "information": "info", "notice": "info", "ntc": "info", "i": "info", "n": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn", "w": "warn",
    "error": "error", "err": "error", "eror": "error", "severe": "error", "e": "error",
    "fatal": "fatal", "ftl": "fatal", "critical": "fatal", "crit": "fatal", "crt": "fatal", "panic": "fatal", "pnc": "fatal", "emerg": "fatal", "alert": "fatal", "f": "fatal", "c": "fatal",
}
ESCAPES = r"\x1b\[[0-9;]*[A-Za-z]"
LEVEL_WORDS = "|".join(sorted((w for w in LEVELS if len(w) > 1), key=len, reverse=True))
NAME = r"[A-Za-z_][\w\-]*(?:\.[\w\-]+)*"


def plain(line: Column) -> Column:
    """The line without colour codes and trailing white space."""
    bare = F.when(F.contains(line, F.lit("\x1b")), F.regexp_replace(line, ESCAPES, "")).otherwise(line)
    return F.rtrim(bare, F.lit(" \t\r\n\x0b\x0c"))


def alike(line: Column) -> Column:
    """A cheap first reduction, after which equal lines are counted once: every
    digit as 0, long hexadecimal ids as one, runs of small words as one word,
    free-standing numbers (not parts of times or addresses) at one length."""
    c = F.translate(plain(line), "123456789", "0" * 9)
    c = F.regexp_replace(c, r"\b(?:(?=[0a-f]{6})0*[a-f][0a-f-]*|0{8}-[0a-f-]{27}|0x[0a-f]+)\b", "a0")
    c = F.regexp_replace(c, r"\b0{1,3}\.0{1,3}\.0{1,3}\.0{1,3}(?::0+)?\b", "0.0.0.0")
    c = F.regexp_replace(c, r"(?<= )[a-z]{2,}+(?:,? [a-z]{2,}+)+(?= )", "w")
    return F.regexp_replace(c, r"(?<=[ =(])0{2,9}(?=[ ,a-z\]\")%]|$|: )|(?<=[a-z][/-])0{2,9}(?=[ ,\]\")]|$)|(?<=[ =])0{1,9}\.0+(?=[a-z])", "0")


def mask(line: Column) -> Column:
    """The shape of a plain line: each token replaced by its kind, keys and punctuation kept."""
    c = F.regexp_replace(line, r"[\ue000-\ue0ff]", "?")
    for kind, pattern in TIMES.items():
        if kind == COMPACT:
            c = F.regexp_replace(c, rf"(?<=^[A-Z]){pattern}", kind)
        else:
            c = F.regexp_replace(c, rf"(?<![\w.:-]){pattern.replace('1', '[01]', 1) if pattern[0] == '1' else pattern}(?![\w-])(?!:\d)", kind)
    c = F.regexp_replace(c, r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", ADDRESS)
    c = F.regexp_replace(c, r'"([@\w.\-]+)"\s*:\s*', f"{JKEY0}$1{JKEY1}")
    c = F.regexp_replace(c, r"(?<![\w./=?&-])([A-Za-z_][\w.]*)=(?!=)", f"{FKEY0}$1{FKEY1}")
    c = F.regexp_replace(c, rf"(?i)(?<![\w.\-])(?:{LEVEL_WORDS})(?![\w.\-]*[\w\-{JKEY1}{FKEY1}])", LEVEL)
    c = F.regexp_replace(c, rf"(?<![\w.\-])[TVDINWEFC](?=[/{COMPACT}])", LEVEL)
    c = F.regexp_replace(c, r"(?<![\w.\-])(?:UTC|GMT)(?![\w.\-])", ZONE)
    edge = rf"(?![\w.\-]*[{JKEY1}{FKEY1}])"
    c = F.regexp_replace(c, rf"(?<![\w@.\-{JKEY0}{FKEY0}])[A-Za-z_][\w\-]*+(?:\.[\w\-]++)++{edge}", DOTTED)
    c = F.regexp_replace(c, rf"(?<![\w@.\-{JKEY0}{FKEY0}])[\w\-]*\d[\w\-]*[A-Za-z][\w\-]*{edge}|(?<![\w@.\-{JKEY0}{FKEY0}])[A-Za-z_][\w\-]*\d[\w\-]*{edge}", IDENT)
    c = F.regexp_replace(c, rf"(?<![\w@.{JKEY0}{FKEY0}])\d[\d.,]*{edge}", NUMBER)
    c = F.regexp_replace(c, rf"(?<![\w@.\-{JKEY0}{FKEY0}])[^\W\d][\w\-]*{edge}", WORD)
    c = F.regexp_replace(c, rf"{WORD}(?:[ ,;:]+[{WORD}{NUMBER}{IDENT}])+(?![\[:])", WORD)
    return F.regexp_replace(c, r"  +", " ")


TOKEN = re.compile(rf"{JKEY0}[^{JKEY1}]*{JKEY1}|{FKEY0}[^{FKEY1}]*{FKEY1}|.", re.S)


def tokens(shape: str) -> list[str]:
    return TOKEN.findall(shape)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine-word step per token of ``b``."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_template(a: list[str], b: list[str]) -> list[str]:
    """Common subsequence of two token lists, a gap where either has more."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out: list[str] = []
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        else:
            if not out or out[-1] != GAP:
                out.append(GAP)
            i, j = (i + 1, j) if best[i + 1][j] >= best[i][j + 1] else (i, j + 1)
    if (i < n or j < m) and (not out or out[-1] != GAP):
        out.append(GAP)
    return out


@dataclass(frozen=True)
class Layout:
    """The header of a program's layout: a Java regex and what its groups hold."""

    regex: str
    time: int = 0
    kind: str = ""
    level: int = 0
    component: int = 0

    @property
    def first(self) -> str:
        """The characters a line of this layout may start with."""
        r = self.regex[1:]
        if r.startswith(("(?=\\{", "\\[", "\\(", "\\<", "<")):
            return next(x for x in r if x in "{[(<" and r[r.index(x) - 1] in "\\^" or x == "<")
        if r.startswith("(?="):
            return r[3]
        if r.startswith("((?:Jan"):
            return "JFMASOND"
        return "".join(map(chr, (*range(65, 91), *range(97, 123)))) if r.startswith("([A-Z") else "0123456789"

    def may_head(self, line: Column) -> Column:
        """A cheap test that all lines of this layout pass: the first character,
        and the place of the first punctuation of a time in the first column."""
        test = F.substring(line, 1, 1).isin(list(self.first))
        place = {ISO: (5, "-"), SLASH: (5, "/"), CLOCK: (3, ":"), BSD: (4, " ")}.get(self.kind)
        if place and self.regex.startswith("^(" + TIMES[self.kind]):
            test = test & (F.substring(line, place[0], 1) == place[1])
        return test

    @property
    def key(self) -> str:
        return f"{self.regex}\x00{self.time}\x00{self.kind}\x00{self.level}\x00{self.component}"


#: One logfmt pair; quoted text is stepped over as a whole, so nothing in it passes for a key.
PAIR = r'[^\s"=]+=(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s"]*)'


def _literal(t: str) -> str:
    return " +" if t == " " else re.sub(r"([\\.\[\]{}()*+?^$|\-/\"&#~])", r"\\\1", t)


def _keyed(ts: list[str]) -> Layout | None:
    """A line of key-value pairs: JSON object or logfmt, roles by the kind of value."""
    json_like = ts[0] == "{"
    lo, hi = (JKEY0, JKEY1) if json_like else (FKEY0, FKEY1)
    roles: dict[str, tuple[str, str]] = {}
    i = 1 if json_like else 0
    while i < len(ts):
        t = ts[i]
        if t[0] == lo and t[-1] == hi:
            j = i + 1
            if j < len(ts) and ts[j] == '"':
                j += 1
            v = ts[j] if j < len(ts) else ""
            closed = j + 1 >= len(ts) or ts[j + 1] in '",} '
            name = t[1:-1]
            if closed and v in TIMES and "time" not in roles:
                roles["time"] = (name, v)
            elif closed and v == LEVEL and "level" not in roles:
                roles["level"] = (name, v)
            elif closed and v == DOTTED and "component" not in roles:
                roles["component"] = (name, v)
            elif closed and v == WORD and name.lower() in ("logger", "component", "module", "tag", "program", "caller") and "component" not in roles:
                roles["component"] = (name, v)
        i += 1
    if "time" not in roles or len(roles) < 2:
        return None

    def ahead(role: str, value: str) -> str:
        name = re.sub(r"([.@\-])", r"\\\1", roles[role][0])
        if json_like:
            return rf'(?=.*?"{name}"\s*:\s*"?({value})(?![\w.]))'
        return rf'(?=(?:{PAIR}\s+)*?{name}="?({value})(?![\w.]))'

    order = [r for r in ("time", "level", "component") if r in roles]
    value = {"time": TIMES[roles["time"][1]], "level": "[A-Za-z]+", "component": r"[\w.\-/]+"}
    first = next(t for t in ts if t[-1] == hi)
    name = re.sub(r"([.@\-])", r"\\\1", first[1:-1])
    start = rf'\{{\s*"{name}"\s*:' if json_like else rf"{name}="
    regex = f"^(?={start})" + "".join(ahead(r, value[r]) for r in order)
    g = {r: i + 1 for i, r in enumerate(order)}
    return Layout(regex, g["time"], roles["time"][1], g.get("level", 0), g.get("component", 0))


def layout_of(ts: list[str], shapes: int = 2) -> Layout | None:
    """The header that a template opens with, or None.

    The header is read from the first token on, up to the first free text. It
    must hold a time, or a level with a component, in the first column. What
    varies between the ``shapes`` merged into the template is a gap; a word is
    taken for a component, and a header without time for one at all, only if
    two shapes or more, that is messages of different make, have it in common.
    """
    if not ts:
        return None
    if (ts[0] == "{" and len(ts) > 1 and ts[1][0] == JKEY0) or ts[0][0] == FKEY0:
        return _keyed(ts)
    if not (ts[0] in TIMES or ts[0] in (LEVEL, ADDRESS) or (ts[0] in ("[", "<", "(") and len(ts) > 1 and (ts[1] in TIMES or ts[1] in (LEVEL, NUMBER)))):
        return None
    regex, keep, groups = "^", "", 0
    time = level = comp = 0
    kind = ""
    after = lambda k: ts[k] if k < len(ts) else ""
    comp_dotted = glued = False  # glued: no space since the last role, so what closes it is kept
    i = 0
    while i < len(ts):
        t, nxt, prev = ts[i], after(i + 1), ts[i - 1] if i else ""
        if t in TIMES and not time and not comp:
            groups += 1
            time, kind = groups, t
            regex += f"({TIMES[t]})"
            keep, glued = regex, True
        elif t == LEVEL and not level:
            if i and not time and prev == " " and not comp or comp and prev == " " and ts[i - 2] == ":":
                break
            groups += 1
            level = groups
            regex += "([A-Za-z])" if nxt == COMPACT else "([A-Za-z]+)"
            keep, glued = regex, True
        elif t == GAP and time and not comp and prev == " " and nxt == " ":
            regex += r"\S+"
        elif t in (DOTTED, WORD) and not comp_dotted:
            enclosed = (prev in ("[", "(", "/", "|") and nxt in ("]", ")", "|", ":"))
            tag = nxt == "[" and after(i + 2) == NUMBER and after(i + 3) == "]"
            colon = nxt == ":" and (time or level)
            dash = t == DOTTED and nxt == " " and after(i + 2) == "-"
            before_level = t == DOTTED and nxt == " " and after(i + 2) == LEVEL and not level
            if (time or level) and (enclosed or tag or colon or dash or before_level):
                if (comp or shapes < 2) and t != DOTTED:
                    break
                groups += 1
                comp, comp_dotted = groups, t == DOTTED
                regex += r"([\w.\-]+)" if t == DOTTED else r"([A-Za-z_][\w\-]*)"
                if dash:
                    regex, i = regex + " +\\-", i + 2
                keep, glued = regex, True
            elif (time or level) and prev == " " and nxt == " " and not comp and i <= 3 and t == WORD and _tag_follows(ts, i + 2):
                regex += r"\S+"
            else:
                break
        elif t == NUMBER and ((prev in ("[", "(", ":", "<") or nxt in ("]", ")")) or (prev == " " and nxt == " " and not comp and time and (_tag_follows(ts, i + 2) or after(i + 2) == DOTTED))):
            regex += r"[\d.,]+"
            keep = regex if glued else keep
        elif t == IDENT and (prev in ("[", "(") and nxt in ("]", ")") or (time and not comp and prev == " " and nxt == " ")):
            regex += r"[\w.\-]+"
        elif t == ADDRESS and i == 0:
            regex += r"\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?"
        elif t == ZONE and time and not comp:
            regex += "(?:UTC|GMT)"
        elif t == " " or t in "[](){}<>|:/-,#=" and not (t == "-" and i == 0):
            regex += _literal(t)
            glued = glued and (t in "])>|:" or t == "[" and nxt == NUMBER)
            keep = regex if glued else keep
        else:
            break
        i += 1
    if not (time or (level and comp and shapes > 1)):
        return None
    if not time and level and comp and not (ts[0] == LEVEL or ts[0] in "[<("):
        return None
    if not time and not comp_dotted and (after(1), after(2)) not in ((":", WORD), (" ", WORD)):
        return None
    return Layout(keep, time, kind, level, comp)


def _tag_follows(ts: list[str], i: int) -> bool:
    """A tag with a process number, a tag with a colon, or a dotted name comes next."""
    t = ts[i] if i < len(ts) else ""
    n = ts[i + 1] if i + 1 < len(ts) else ""
    return t in (WORD, DOTTED) and n in ("[", ":")


def roles(ts: list[str]) -> tuple[str, ...]:
    """What a template's header tells: its time's format, level, component."""
    lay = layout_of(ts)
    return (lay.kind, *(["level"] if lay.level else []), *(["component"] if lay.component else [])) if lay else ()


def cluster(shapes: Iterable[tuple[str, int, int]], similarity: float = 0.8) -> list[tuple[list[str], int, int]]:
    """Merge (shape, lines, shapes merged so far) into templates by longest common subsequence.

    A shape joins the template with which it shares the most tokens, if these
    are at least ``similarity`` of the constant ones of the shorter (without a
    header: the longer) and the merged template tells what both told: a slot
    with a role is never lost. Frequent
    shapes come first, ties in text order, so the result doesn't depend on the
    order of the input.
    """
    out: list[list] = []
    buckets: dict[str, list[int]] = {}
    for shape, lines, n_shapes in sorted(shapes, key=lambda x: (-x[1], x[0])):
        ts = tokens(shape)
        mine = roles(ts)
        # a line may only begin where its program's lines begin
        bucket = buckets.setdefault(ts[0] if ts else "", [])
        best, most = None, 0
        for k in bucket:
            other = out[k][0]
            n = lcs_length(other, ts)
            constant = len(other) - other.count(GAP)
            if n > most and n >= similarity * (min if mine else max)(constant, len(ts)) and out[k][3] == mine:
                best, most = k, n
        if best is not None:
            merged = lcs_template(out[best][0], ts)
            if roles(merged) == mine:
                out[best] = [merged, out[best][1] + lines, out[best][2] + n_shapes, mine]
                continue
        bucket.append(len(out))
        out.append([ts, lines, n_shapes, mine])
    return [(t, n, k) for t, n, k, _ in out]


TEMPLATES = "template string, lines bigint, shapes bigint, regex string, time_group int, time_kind string, level_group int, component_group int"


def mine(df: DataFrame, line: str, *, similarity: float = 0.8) -> DataFrame:
    """Templates of all lines: ``template`` string, ``lines`` and ``shapes`` bigint, and its layout.

    Shapes are counted with a hash aggregate (map-side first), clustered per
    partition of shapes, and the partition templates merged the same way per
    first tokens. The number of rows depends on how many ways of writing there
    are, not on lines. Null lines are left out.
    """
    first = df.where(F.col(line).isNotNull()).select(alike(F.col(line)).alias("z")).groupBy("z").agg(F.count(F.lit(1)).alias("n"))
    shapes = first.select(mask(F.col("z")).alias("shape"), "n").groupBy("shape").agg(F.sum("n").alias("lines"))

    def rows(found: list[tuple[list[str], int, int]]) -> pd.DataFrame:
        got = []
        for t, n, k in found:
            lay = layout_of(t, k)
            got.append(("".join(t), n, k, lay.regex if lay else None, lay.time if lay else 0, lay.kind if lay else "", lay.level if lay else 0, lay.component if lay else 0))
        return pd.DataFrame(got, columns=[c.split()[0] for c in TEMPLATES.split(", ")])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, int, int]] = []
        for b in batches:
            held += [(s, int(n), 1) for s, n in zip(b["shape"], b["lines"])]
            if len(held) > 50_000:
                held = [("".join(t), n, k) for t, n, k in cluster(held, similarity)]
        yield rows(cluster(held, similarity))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return rows(cluster([(t, int(n), int(k)) for t, n, k in zip(g["template"], g["lines"], g["shapes"])], similarity))

    # lines that open with free text tell no header: they are merged by more of their beginning, so no group is large
    local = shapes.mapInPandas(part, TEMPLATES)
    head = F.substring("template", 1, 1)
    return local.groupBy(F.when(head.isin(*FREE, " ", "\t"), F.substring("template", 1, 4)).otherwise(head).alias("h")).applyInPandas(merge, TEMPLATES)


KIND_NAMES = {
    **{t: "time" for t in TIMES}, LEVEL: "level", DOTTED: "name", IDENT: "id", NUMBER: "number", WORD: "text", ADDRESS: "address", ZONE: "zone", GAP: "...",
}


def readable(template: str) -> str:
    """A template as text: constants as they are, variable slots as ``<kind>``."""
    names = {JKEY0: '"', JKEY1: '": ', FKEY0: "", FKEY1: "="}
    return "".join(f"<{KIND_NAMES[t]}>" if t in KIND_NAMES else "".join(names.get(x, x) for x in t) for t in tokens(template))


#: Bound on distinct layouts; each is one branch of the compiled parse expression.
MAX_LAYOUTS = 400


def layouts(df: DataFrame, line: str) -> list[Layout]:
    """The distinct headers among the mined templates, the most specific first.

    Their number is the number of programs' layouts. Beyond ``MAX_LAYOUTS``
    an error says so; nothing is left out silently.
    """
    m = mine(df, line).where("regex is not null").groupBy("regex", "time_group", "time_kind", "level_group", "component_group").agg(F.sum("lines").alias("lines"))
    got = m.limit(MAX_LAYOUTS + 1).collect()
    if len(got) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} header layouts; mine the sources one by one")
    rank = lambda r: (-((r.time_group > 0) + (r.level_group > 0) + (r.component_group > 0)), -len(r.regex), r.regex)
    return [Layout(r.regex, r.time_group, r.time_kind, r.level_group, r.component_group) for r in sorted(got, key=rank)]
