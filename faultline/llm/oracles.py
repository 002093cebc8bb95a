"""DuckDB SQL of the operators whose results SQL can express at length."""

from __future__ import annotations

from . import mixing


def mixing_sql() -> str:
    """Shares by recursion, seats by ranking every quotient, block by block."""
    a, b = mixing._STEPS
    return rf"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS n, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        hashed AS (
            SELECT *, ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 15))::BIGINT AS h FROM docs),
        sources AS (
            SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM docs GROUP BY source),
        weighed AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sources),
        levels(step, level, n) AS (
            SELECT 0, (1.5::DOUBLE * sum(size)::DOUBLE) / sum(w)::DOUBLE, -1 FROM weighed
            UNION ALL
            SELECT step + 1,
                (1.5::DOUBLE * sum(size)::DOUBLE - sum(CASE WHEN w * level > 2 * size THEN 2 * size ELSE 0 END)::DOUBLE)
                    / sum(CASE WHEN w * level > 2 * size THEN 0 ELSE w END)::DOUBLE, count(*) FILTER (w * level > 2 * size)::INT
            FROM levels, weighed GROUP BY step, level, n
            HAVING count(*) FILTER (w * level > 2 * size) > greatest(n, 0) AND count(*) FILTER (w * level <= 2 * size AND w > 0) > 0),
        aims AS (
            SELECT source, i, size, CASE WHEN w * level > 2 * size THEN (2 * size)::DOUBLE ELSE w * level END AS target
            FROM weighed, (SELECT arg_max(level, step) AS level FROM levels)),
        shards AS (
            SELECT source, h % {mixing.SHARDS} AS shard, sum(size)::BIGINT AS words,
                CASE WHEN sum(size) = 0 THEN 0 ELSE greatest(1, (2 * sum(size)::BIGINT + {mixing.BLOCK}) // {2 * mixing.BLOCK}) END AS blocks
            FROM hashed GROUP BY ALL),
        voted AS (
            SELECT a.*, b.blocks, CASE WHEN size = 0 THEN 0 ELSE floor(target * b.blocks / size * {mixing._VOTES})::BIGINT END AS votes
            FROM aims a JOIN (SELECT source, sum(blocks)::BIGINT AS blocks FROM shards GROUP BY source) b ON a.source IS NOT DISTINCT FROM b.source),
        seats AS (
            SELECT source, count(*) AS given FROM (
                SELECT source, row_number() OVER (ORDER BY votes::DOUBLE / (2 * k + 1) DESC, i, k) AS place
                FROM (SELECT *, unnest(range(0, 2 * blocks)) AS k FROM voted WHERE votes > 0))
            WHERE place <= (SELECT (sum(votes)::BIGINT + {mixing._VOTES // 2}) // {mixing._VOTES} FROM voted) GROUP BY source),
        quotas AS (
            SELECT c.source, c.shard, count(*) AS quota FROM (
                SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY blocks::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
                FROM (SELECT *, unnest(range(0, 2 * blocks)) AS k FROM shards)) c
            JOIN seats s ON s.source IS NOT DISTINCT FROM c.source WHERE place <= given GROUP BY c.source, c.shard),
        placed AS (
            SELECT d.*, s.words, s.blocks, coalesce(q.quota, 0) AS quota, d.upto - d.size AS pos,
                ('0x' || substr(md5('{mixing.SEED}|' || coalesce(d.source, '') || '|' || d.shard), 1, 15))::BIGINT AS start
            FROM (SELECT *, h % {mixing.SHARDS} AS shard, sum(size) OVER (PARTITION BY source, h % {mixing.SHARDS}
                    ORDER BY h, doc_id NULLS FIRST, size, n)::BIGINT AS upto FROM hashed) d
            JOIN shards s ON s.source IS NOT DISTINCT FROM d.source AND s.shard = d.shard
            LEFT JOIN quotas q ON q.source IS NOT DISTINCT FROM d.source AND q.shard = d.shard),
        touched AS (
            SELECT *, unnest(range(greatest(0, pos * blocks // words - slack), least(blocks, (pos + size) * blocks // words + slack + 1))) AS j
            FROM (SELECT *, blocks * blocks // words // 4 + 2 AS slack FROM placed WHERE size > 0)),
        cut AS (
            SELECT n, greatest(0, least((j + 1) * (words // blocks) + least(j + 1, words % blocks), pos + size)
                    - greatest(j * (words // blocks) + least(j, words % blocks), pos))
                * (quota // blocks + CASE WHEN (j * CASE WHEN blocks % {a} <> 0 OR blocks = 1 THEN {a} ELSE {b} END + start % blocks) % blocks
                    < quota % blocks THEN 1 ELSE 0 END) AS words
            FROM touched)
        SELECT d.doc_id, d.size, a.size AS source_size, a.target, coalesce(t.taken, 0)::BIGINT AS taken
        FROM docs d JOIN aims a ON a.source IS NOT DISTINCT FROM d.source
        LEFT JOIN (SELECT n, sum(words)::BIGINT AS taken FROM cut GROUP BY n) t ON t.n = d.n"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every distance of every round; codebooks as tables."""
    ctes = [f"""
        fine AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cells AS (
            SELECT n, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS pos,
                floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x
            FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM fine)),
        book0 AS (SELECT part, n - 1 AS entry, pos, x AS b FROM cells WHERE n <= {entries})"""]
    for i in range(rounds + 1):
        ctes.append(f"""
        near{i} AS (
            SELECT n, part, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS d
            FROM (SELECT n, part, entry, sum((x - b) * (x - b))::BIGINT AS d FROM cells JOIN book{i} USING (part, pos) GROUP BY n, part, entry)
            GROUP BY n, part)""")
        if i < rounds:
            ctes.append(f"""
        book{i + 1} AS (
            SELECT part, entry, pos, coalesce(floor(total::DOUBLE / many)::BIGINT, b) AS b
            FROM book{i} LEFT JOIN (SELECT part, entry, pos, sum(x)::BIGINT AS total, count(*) AS many FROM cells JOIN near{i} USING (n, part)
                GROUP BY part, entry, pos) USING (part, entry, pos))""")
    return f"""
        WITH {",".join(ctes)},
        coded AS (
            SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY n)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
            (SELECT sha256(string_agg(b::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN fine USING (n)"""


MANIFEST = """
    WITH RECURSIVE read AS (
        SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents),
    fields AS (
        SELECT doc_id, lang, text, lowered, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM read),
    digests AS (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) AS lowered_leaf FROM fields),
    crc AS (
        SELECT 0 AS i, range::BIGINT AS byte, range::BIGINT AS c FROM range(256)
        UNION ALL SELECT i + 1, byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE i < 8),
    sums AS (
        SELECT doc_id, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
        UNION ALL
        SELECT doc_id, s.i + 1, xor(t.c, s.c // 256) FROM sums s JOIN crc t
            ON t.i = 8 AND s.i < length(doc_id::VARCHAR) AND t.byte = xor(s.c & 255, ascii(substr(doc_id::VARCHAR, s.i + 1, 1))::BIGINT)),
    touched AS (SELECT doc_id, xor(c, 4294967295) % 3 = 0 AS yes FROM sums WHERE i = length(doc_id::VARCHAR)),
    leaves AS (
        SELECT row_number() OVER () AS id, d.doc_id, leaf, CASE WHEN t.yes THEN lowered_leaf ELSE leaf END AS claimed,
            dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY lang ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
        FROM digests d LEFT JOIN touched t ON t.doc_id = d.doc_id),
    nodes(tree, level, pos, n, h) AS (
        SELECT tree, 0, pos, n, leaf FROM leaves
        UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1
            GROUP BY tree, level, pos // 8, n),
    top(level, pos, n, h) AS (
        SELECT 0, tree, count(*) OVER (), h FROM nodes WHERE n = 1
        UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
    beside AS (
        SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
            coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
        FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
    beside_top AS (
        SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
            coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
        FROM top a JOIN top b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
    low(id, tree, level, pos, h, proof) AS (
        SELECT id, tree, 0, pos, claimed, '' FROM leaves
        UNION ALL SELECT f.id, f.tree, f.level + 1, f.pos // 8, sha256(l || h || r), proof || l || r
        FROM low f JOIN beside b ON f.tree = b.tree AND f.level = b.level AND f.pos = b.pos),
    high(id, level, pos, h, proof) AS (
        SELECT id, 0, f.tree, f.h, f.proof FROM low f JOIN nodes n ON n.n = 1 AND n.tree = f.tree AND n.level = f.level AND n.pos = f.pos
        UNION ALL SELECT f.id, f.level + 1, f.pos // 8, sha256(l || h || r), proof || l || r
        FROM high f JOIN beside_top b ON f.level = b.level AND f.pos = b.pos)
    SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
    FROM leaves JOIN high f USING (id) JOIN top t ON t.n = 1 AND t.level = f.level JOIN nodes s ON s.n = 1 AND s.tree = leaves.tree"""
