"""SQL that the queries of this package must agree with, where SQL can express them."""

from __future__ import annotations

_FAR = "list_sum(list_transform(generate_series(1, 64), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"


def centroid_clusters(k: int = 8, rounds: int = 10) -> str:
    """Every round in turn: the nearest centroid of each vector, then floored means."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {k})"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, v.x, c.k, {_FAR} AS d FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.k) = 1)")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT k, list(m ORDER BY i) AS x FROM (SELECT k, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, generate_series(1, 64) g(i) GROUP BY 1, 2)) GROUP BY 1),
  c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    end = rounds
    return "WITH " + ",\n ".join(steps) + f"""
 SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
   sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{end} a JOIN c{end} c USING (k)"""


#: crc32 by its table, over the bytes of `<doc_id>:<run>`; near words share what is left when one letter is taken out.
SPELLING_VARIANTS = """WITH RECURSIVE bits(i, c, r) AS (SELECT i, i, 0 FROM generate_series(0, 255) g(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, r + 1 FROM bits WHERE r < 8),
 crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE r = 8),
 runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
 per AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, w, count(*) AS n FROM runs GROUP BY 1, 2),
 hex AS (SELECT d, w, n, hex(encode(d || ':' || w)) AS x FROM per),
 hashed AS (SELECT w, n, xor(list_reduce(list_transform(generate_series(1, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM hex, crc),
 cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
 words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
 less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
 near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
   UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.rest),
 best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, {'n': -m, 'w': encode(other)}) AS other FROM near GROUP BY 1),
 forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
 path(word, root, hops) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT p.word, f.form, hops + 1 FROM path p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL)
 SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, hops) AS root FROM path GROUP BY 1) USING (word)"""
