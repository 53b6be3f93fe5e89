"""DuckDB SQL fragments for the oracle twins (RE2 regexes, Unicode word classes)."""

from __future__ import annotations

import re

# Java (?U)\w: letters, letter numbers, marks, decimal digits, connector punctuation.
W = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(col: str) -> str:
    """normalize_text twin."""
    return (f"trim(regexp_replace(regexp_replace(lower(coalesce({col}, '')), '[^{W}\\s]', '', 'g'), "
            f"'\\s+', ' ', 'g'))")


def whole_word_re(kw: str) -> str:
    r"""RE2 twin of Java (?iuU)\b\Qkw\E\b: a boundary is a change of word-ness."""
    esc = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", kw)
    first_word = bool(re.match(r"\w", kw[0])) if kw else False
    last_word = bool(re.match(r"\w", kw[-1])) if kw else False
    pre = f"(^|[^{W}])" if first_word else f"[{W}]"
    post = f"($|[^{W}])" if last_word else f"[{W}]"
    return "(?i)" + pre + esc + post


def ww_match(col: str, kw: str) -> str:
    return f"regexp_matches({col}, {sql_str(whole_word_re(kw))})"


def py_title(expr: str) -> str:
    """Python str.title() twin."""
    return (f"array_to_string(list_transform(regexp_extract_all(lower({expr}), '(\\p{{L}}+|[^\\p{{L}}]+)'),"
            f" lambda s: CASE WHEN left(s, 1) = 'ß' THEN 'Ss' ELSE upper(left(s, 1)) END || substr(s, 2)), '')")


def simhash_ctes(src: str, id_col: str, text_expr: str, prefix: str = "s") -> str:
    """CTEs ending in ``{prefix}_fp(id, fp UBIGINT)``: SimHash of ``text_expr`` per row
    of ``src`` (a CTE/table name); text without words gives 0."""
    return f"""
  {prefix}_d AS (SELECT {id_col} AS id, {norm(text_expr)} AS nt FROM {src}),
  {prefix}_w AS (SELECT id, unnest(string_split(nt, ' ')) AS w FROM {prefix}_d),
  {prefix}_h AS (SELECT id, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM {prefix}_w WHERE w <> ''),
  {prefix}_v AS (SELECT id, b.i AS i, sum(CASE WHEN ((h >> b.i::UBIGINT) & 1::UBIGINT) = 1 THEN 1 ELSE -1 END) AS s
          FROM {prefix}_h CROSS JOIN range(64) b(i) GROUP BY id, b.i),
  {prefix}_f AS (SELECT id, bit_or(CASE WHEN s > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END) AS fp
          FROM {prefix}_v GROUP BY id),
  {prefix}_fp AS (SELECT d.id, coalesce(f.fp, 0::UBIGINT) AS fp FROM {prefix}_d d LEFT JOIN {prefix}_f f USING (id))"""


def fold_ctes(src: str, key_expr: str, order_by: str, max_d: int = 9, prefix: str = "r") -> str:
    """Recursive CTE ``{prefix}`` over ``src(id, fp, ...)``: the ordered near-duplicate
    rule per key (admitted flag per row)."""
    return f"""
  {prefix}_k AS (SELECT id, fp, {key_expr} AS fkey,
                 row_number() OVER (PARTITION BY {key_expr} ORDER BY {order_by}) AS rn FROM {src}),
  {prefix} AS (SELECT fkey, rn, id, fp AS state, true AS admitted FROM {prefix}_k WHERE rn = 1
        UNION ALL
        SELECT k.fkey, k.rn, k.id,
               CASE WHEN bit_count(xor(q.state, k.fp)) > {max_d} THEN k.fp ELSE q.state END,
               bit_count(xor(q.state, k.fp)) > {max_d}
        FROM {prefix} q JOIN {prefix}_k k ON k.fkey = q.fkey AND k.rn = q.rn + 1)"""
