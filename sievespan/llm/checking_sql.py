"""DuckDB SQL of the operators whose SQL is made by a rule: hashes, and the k-d tree level by level."""

# The remainders of crc32, and its value of a list of bytes; to be used beside `tab`.
CRC_TABLE = """tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) AS t
         FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))"""


def crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text that isn't null."""
    as_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST(('0x' || x) AS BIGINT))"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {as_bytes}), "
            "lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])))")


def kd_shards(dimensions: dict[str, bool], shards: int) -> str:
    """Shards of ``documents``; ``dimensions``: by column whether it holds numbers."""
    n = len(dimensions)
    places = [f"CAST({d} AS DOUBLE)" if number else f"CAST(CAST('0x' || rpad(left(hex(encode({d})), 12), 12, '0') AS BIGINT) AS DOUBLE)"
              for d, number in dimensions.items()]
    ranks = [f"row_number() OVER (ORDER BY {d} NULLS FIRST, text_crc32, doc_id NULLS FIRST) AS r{i}" for i, d in enumerate(dimensions)]
    parts = [f"""WITH {CRC_TABLE},
sized AS (SELECT doc_id, {', '.join(d for d in dimensions if d != 'doc_id')}, strlen(coalesce(text, '')) + 8 AS size,
                 {crc32("coalesce(text, '')")} AS text_crc32 FROM documents, tab),
t0 AS (SELECT doc_id, size, text_crc32, {', '.join(f'{p} AS x{i}' for i, p in enumerate(places))}, {', '.join(ranks)}, 0 AS node FROM sized),
whole AS (SELECT {', '.join(f'max(x{i}) - min(x{i}) AS e{i}' for i in range(n))} FROM t0)"""]
    leaves, level = {0: shards}, 0
    while max(leaves.values()) > 1:
        t = f"t{level}"
        width = ", ".join(f"CASE WHEN min(x{i}) IS NULL THEN -1 WHEN any_value(e{i}) > 0 THEN (max(x{i}) - min(x{i})) / any_value(e{i}) ELSE 0 END AS w{i}"
                          for i in range(n))
        widest = " ".join(f"WHEN w{i} >= greatest({', '.join(f'w{j}' for j in range(i, n))}) THEN {i}" for i in range(n))
        rank = " ".join(f"WHEN {i} THEN r{i}" for i in range(n))
        split = ", ".join(f"({i}, {k}, {k // 2})" for i, k in leaves.items())
        parts.append(f"""s{level} AS (SELECT node, k, l, sum(size) AS total, {width} FROM {t} JOIN (VALUES {split}) v(node, k, l) USING (node), whole
       WHERE k > 1 GROUP BY node, k, l),
o{level} AS (SELECT {t}.*, k * (sum(size) OVER (PARTITION BY node ORDER BY r)) - l * total AS off, l * total AS none, r
       FROM (SELECT {t}.*, k, l, total, CASE (CASE {widest} END) {rank} END AS r FROM {t} LEFT JOIN s{level} USING (node)) {t}),
c{level} AS (SELECT node, min(r) FILTER (WHERE abs(off) = least_off AND least_off < none) AS cut
       FROM (SELECT *, min(abs(off)) OVER (PARTITION BY node) AS least_off FROM o{level}) GROUP BY node),
t{level + 1} AS (SELECT doc_id, size, text_crc32, {', '.join(f'x{i}, r{i}' for i in range(n))},
       2 * node + CASE WHEN r > coalesce(cut, -1) THEN 1 ELSE 0 END AS node FROM o{level} JOIN c{level} USING (node))""")
        leaves = {j: m for i, k in leaves.items()
                  for j, m in ([(2 * i, k // 2), (2 * i + 1, k - k // 2)] if k > 1 else [(2 * i, 1)])}
        level += 1
    named = ", ".join(f"({node}, {shard})" for shard, node in enumerate(sorted(leaves)))
    return ",\n".join(parts) + f"""
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM t{level} JOIN (VALUES {named}) v(node, shard) USING (node)"""


TRIE = f"""
WITH {CRC_TABLE},
own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, {crc32("CAST(c AS VARCHAR)")} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM own), tab),
headed AS (SELECT conv.*, least(h, coalesce(n, 0)) AS taken FROM conv LEFT JOIN (SELECT c AS base, count(*) AS n FROM own GROUP BY c) USING (base)),
turned AS (SELECT headed.c, pos AS d, role, text FROM headed JOIN own ON own.c = headed.base AND pos <= h
           UNION ALL SELECT c, pos - h + taken, role, text FROM headed JOIN own USING (c) WHERE pos > h),
p AS (SELECT c, d, length(text) AS chars,
             string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS prefix FROM turned
      UNION ALL SELECT c, 0, 0, '' FROM conv),
node AS (SELECT prefix, d, min(c) AS c, count(*) AS n, any_value(chars) AS chars FROM p GROUP BY prefix, d),
kids AS (SELECT left(prefix, 32 * (d - 1)) AS prefix, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (prefix)),
below AS (SELECT left(prefix, 32 * up) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * chars) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM whole) GROUP BY 1),
stop AS (SELECT prefix, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM (SELECT c, max_by(prefix, d) AS prefix FROM p GROUP BY c) GROUP BY prefix)
SELECT w.c AS conv_id, w.d AS depth, up.c AS parent_conv_id, w.n AS n_convs, w.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM whole w JOIN below USING (prefix) LEFT JOIN stop USING (prefix)
LEFT JOIN whole up ON w.d > 0 AND up.prefix = left(w.prefix, 32 * (w.d - 1))"""
