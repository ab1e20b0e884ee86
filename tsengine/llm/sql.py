"""DuckDB SQL of the operators whose oracles are built from repeated parts."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string: bit by bit, as DuckDB has no such function."""
    steps = f"flatten(list_transform(regexp_extract_all({text}, '.'), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {step}), 4294967295)"


def merkle(levels: int = 5, source_levels: int = 4) -> str:
    """For up to 16 ** levels rows a source and 16 ** source_levels sources."""
    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(name: str, up: int) -> list[str]:
        out = []
        for k in range(up):
            out.append(f"{name}r{k} AS (SELECT g, p // 16 AS q, any_value(n) AS n, list(d ORDER BY p) AS ds FROM {name}{k} GROUP BY g, p // 16)")
            out.append(f"{name}{k + 1} AS (SELECT g, q AS p, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d, "
                       f"CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n FROM {name}r{k})")
        return out

    def path(start: str, name: str, up: int, out: str) -> list[str]:
        made = []
        for k in range(up):
            at = f"(x.p // {16 ** k}) % 16 + 1"
            left, right = f"array_to_string(ds[1:({at}) - 1], '')", f"array_to_string(ds[({at}) + 1:], '')"
            made.append(f"{out}{k + 1} AS (SELECT x.* REPLACE (CASE WHEN r.n > 1 THEN x.proof || {left} || {right} ELSE x.proof END AS proof, "
                        f"CASE WHEN r.n > 1 THEN sha256({left} || x.fold || {right}) ELSE x.fold END AS fold) "
                        f"FROM {start if k == 0 else f'{out}{k}'} x JOIN {name}r{k} r ON r.g = x.g AND r.q = x.p // {16 ** (k + 1)})")
        return made

    ctes = [
        "d AS (SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g FROM documents)",
        f"""t AS (SELECT doc_id, g, {leaf('text')} AS leaf, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0
 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM d)""",
        "rows AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM t)",
        "a0 AS (SELECT g, p, leaf AS d, n FROM rows)", *tree("a", levels),
        f"subs AS (SELECT g AS own, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM a{levels})",
        "b0 AS (SELECT '' AS g, p, subroot AS d, n FROM subs)", *tree("b", source_levels),
        "f0 AS (SELECT doc_id, g, p, leaf, '' AS proof, coalesce(changed, leaf) AS fold FROM rows)", *path("f0", "a", levels, "f"),
        f"h0 AS (SELECT f.* EXCLUDE (g, p), s.p, '' AS g, s.subroot FROM f{levels} f JOIN subs s ON s.own = f.g)", *path("h0", "b", source_levels, "h"),
    ]
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, "
            f"fold = d AS verified FROM h{source_levels} h JOIN b{source_levels} b ON TRUE")


def trie() -> str:
    return f"""
WITH t AS (SELECT conv_id AS c, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
r AS (SELECT t.c, coalesce(b.own, [])[1:h] || t.own[h + 1:] AS path FROM (SELECT *, {crc32('CAST(c AS VARCHAR)')} % 9 AS h FROM t) t
 LEFT JOIN t b ON b.c = t.c - t.c % 5),
w AS (SELECT c, d, len(path) AS n, CASE WHEN d > 0 THEN strlen(path[d][2]) ELSE 0 END AS bytes,
 array_to_string(list_transform(path[1:d], lambda e: strlen(e[1]) || ':' || e[1] || strlen(e[2]) || ':' || e[2]), '') AS k
 FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM r)),
o AS (SELECT k, d, min(c) AS c, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(c, ',' ORDER BY c) FILTER (d = n), '') AS ends FROM w GROUP BY k, d),
p AS (SELECT o.*, u.k AS up, v.c AS up_c FROM o LEFT JOIN w u ON u.c = o.c AND u.d = o.d - 1 LEFT JOIN o v ON v.k = u.k AND v.d = u.d),
q AS (SELECT up, d - 1 AS d, count(*) AS n FROM p WHERE up IS NOT NULL GROUP BY 1, 2),
s AS (SELECT a.k, a.d, count(*) FILTER (q.n IS NULL) AS n_leaves, sum((o.n_convs - 1) * o.bytes) AS saved
 FROM o JOIN w a ON a.c = o.c AND a.d <= o.d LEFT JOIN q ON q.up = o.k AND q.d = o.d GROUP BY 1, 2)
SELECT p.c AS conv_id, CAST(p.d AS BIGINT) AS depth, up_c AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(coalesce(q.n, 0) AS BIGINT) AS n_children,
 CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM p JOIN s ON s.k = p.k AND s.d = p.d LEFT JOIN q ON q.up = p.k AND q.d = p.d"""
