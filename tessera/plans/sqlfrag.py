"""DuckDB SQL fragments for the oracle queries.

These mirror the Column helpers in ``tessera.functions.text`` so that each
registered query has an independent SQL statement computing the same values.
DuckDB's RE2 has no look-around, so the look-ahead branch of the piece
pattern is dropped (equal on text without whitespace runs) and sentence
splitting substitutes a marker character first.
"""

from __future__ import annotations

from tessera.functions import text as T


def lit(s: str) -> str:
    """A SQL string literal; non-printable characters become chr() calls."""
    parts, buf = [], []
    for ch in s:
        if ch == "'" or ch.isprintable() and ord(ch) < 0x80 or ch.isalnum():
            buf.append("''" if ch == "'" else ch)
        else:
            if buf:
                parts.append("'" + "".join(buf) + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
    if buf:
        parts.append("'" + "".join(buf) + "'")
    if not parts:
        return "''"
    return "(" + " || ".join(parts) + ")"


WS_CHARS = lit(T.WHITESPACE)
NL = "chr(10)"
SEP = "(chr(10) || chr(10))"
# chr(1) is excluded from every branch, so it only ever acts as a boundary.
PIECE_RE2 = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + T.WS[1:-1]
             + r"\p{L}\p{N}\x{01}]+|" + T.WS + "+")


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(T.WS + '+')}), lambda w: w <> '')"


def collapse_ws(x: str) -> str:
    return strip(f"regexp_replace({x}, {lit(T.WS + '+')}, ' ', 'g')")


def ellipsize(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def pieces(x: str) -> str:
    """GPT-2 pieces without look-ahead: a whitespace run followed by a
    non-space loses its last character to the next piece; a chr(1) marker
    in front of that character makes RE2 stop the run there."""
    marked = (f"regexp_replace({x}, {lit('(' + T.WS + '+)(' + T.WS + T.NOT_WS + ')')}, "
              f"'\\1' || chr(1) || '\\2', 'g')")
    return f"regexp_extract_all({marked}, {lit(PIECE_RE2)}, 0)"


def sentences(x: str) -> str:
    return (f"string_split(regexp_replace({x}, {lit('([.!?])' + T.WS + '+')}, "
            f"'\\1' || chr(1), 'g'), chr(1))")


def unique_ratio_bad(x: str, threshold: float = 0.3, over: int = 3) -> str:
    w = words(x)
    return (f"(len({w}) > {over} AND "
            f"len(list_distinct({w}))::DOUBLE / len({w}) < {threshold})")


def clean_book(x: str, end_rule: str = "intended") -> str:
    lines = f"string_split({x}, {NL})"
    start_flags = f"list_transform({lines}, lambda l: upper(l) LIKE '%PREFACE%' OR upper(l) LIKE '%CHAPTER%')"
    end_flags = f"list_transform({lines}, lambda l: lower(l) LIKE '%gutenberg%' OR lower(l) LIKE '%copyright%')"
    spos = f"coalesce(list_position({start_flags}, true), 0)"
    start = f"(CASE WHEN {spos} > 0 THEN {spos} - 1 ELSE 0 END)"
    n = f"len({lines})"
    if end_rule == "intended":
        rpos = f"coalesce(list_position(list_reverse({end_flags}), true), 0)"
        end = f"(CASE WHEN {rpos} > 0 THEN {n} - {rpos} ELSE {n} END)"
    else:
        probe = f"(CASE WHEN {spos} > 0 THEN {lines}[{spos}] ELSE {lines}[{n}] END)"
        end = (f"(CASE WHEN lower({probe}) LIKE '%gutenberg%' OR lower({probe}) LIKE '%copyright%' "
               f"THEN {n} - 1 ELSE {n} END)")
    kept = (f"(CASE WHEN {end} > {start} THEN array_to_string(list_slice({lines}, {start} + 1, {end}), {NL}) "
            f"ELSE '' END)")
    t = f"regexp_replace({kept}, {lit(chr(10) + T.WS + '*' + chr(10))}, {SEP}, 'g')"
    t = f"regexp_replace({t}, {lit('[ ' + chr(9) + ']+')}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(chr(10) + T.WS + '*' + chr(92) + 'p{Nd}+' + T.WS + '*' + chr(10))}, {NL}, 'g')"
    t = (f"regexp_replace({t}, {lit(chr(10) + T.WS + '*CHAPTER [IVXLC' + chr(92) + 'p{Nd}]+' + T.WS + '*' + chr(10))}, "
         f"{SEP}, 'g')")
    return strip(t)


def render_chat(data: str) -> str:
    body = (f"array_to_string(list_transform(list_zip({data}, range(len({data}))), "
            f"lambda z: CASE WHEN z[2] % 2 = 0 THEN 'Human: ' ELSE 'Assistant: ' END "
            f"|| coalesce(z[1], 'None') || {SEP}), '')")
    return f"({body} || '<|endofconversation|>' || {SEP})"
