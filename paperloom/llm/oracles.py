"""DuckDB SQL of the corpus queries that SQL can express, written apart from the operators."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL = rf"""WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) "path" FROM r),
  rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(v, h, q)),
  f AS (SELECT page_id, arg_max(h || q, (len(string_split(h, '.')), length(q))) "rule", arg_max(v, (len(string_split(h, '.')), length(q))) verdict
    FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with("path", q) GROUP BY page_id)
  SELECT p.page_id, host, "path", "rule", coalesce(verdict, 'allow') verdict FROM p LEFT JOIN f USING (page_id)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(\"text\", ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace('\\"', '"')

CONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) item, {_WORDS} w FROM benchmark),
  i AS (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) s FROM b WHERE len(w) > 0), k AS (SELECT DISTINCT item, array_to_string(w[s + 1 : s + 10], ' ') g, len(w[s + 1 : s + 10]) n FROM i),
  g AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) s FROM d, (SELECT DISTINCT n FROM k) z WHERE len(w) >= n)),
  m AS (SELECT doc_id, s, k.n, item FROM g JOIN k ON g.g = k.g), h AS (SELECT doc_id, count(DISTINCT s + o) n_hit FROM (SELECT doc_id, s, unnest(range(n)) o FROM m) GROUP BY doc_id),
  q AS (SELECT g, unnest(string_split(g, ' ')) term, unnest(range(len(string_split(g, ' ')))) off FROM (SELECT DISTINCT g FROM k)), r AS (SELECT g, term, min(off) off FROM q GROUP BY ALL),
  o AS (SELECT doc_id, unnest(w) term, unnest(range(len(w))) pos FROM d), c AS (SELECT term, count(*) c FROM o GROUP BY term),
  a AS (SELECT *, count(*) OVER (PARTITION BY g) most FROM (SELECT g, r.term, off, row_number() OVER (PARTITION BY g ORDER BY coalesce(c, 0), off) nth FROM r LEFT JOIN c ON c.term = r.term) WHERE nth <= 3),
  p AS (SELECT doc_id, g, most, bit_or(CAST(1 << (nth - 1) AS INTEGER)) OVER (PARTITION BY doc_id, g ORDER BY pos - off RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) met FROM o JOIN a ON a.term = o.term),
  e AS (SELECT doc_id, count(DISTINCT g) n_near FROM p WHERE met = (1 << most) - 1 GROUP BY doc_id),
  t AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM m GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(n_near, 0) n_near
  FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id"""


def _level(name: str, keys: list[str], weight: str, before: str, share: float, epochs: int) -> str:
    up, level = keys[:-1], keys[-1]
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    budget = "p.budget" if up else f"{share} * sum(tokens) OVER ()"
    join = f"JOIN {before} p USING ({', '.join(up)})" if up else ""
    return f"""{name}_c AS (SELECT {', '.join(keys)}, tokens * {epochs} capacity, {weight} w, {budget} have FROM (SELECT {', '.join(keys)}, sum(tokens) tokens FROM leaf GROUP BY ALL) {join}),
  {name}_f AS (SELECT *, (have - coalesce(sum(capacity) OVER ({part} ORDER BY capacity / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({part} ORDER BY capacity / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lev FROM {name}_c),
  {name}_m AS (SELECT {', '.join(up) + ', ' if up else ''}arg_min(lev, (capacity / w, {level})) FILTER (WHERE capacity / w > lev) cut FROM {name}_f {'GROUP BY ' + ', '.join(up) if up else ''}),
  {name} AS (SELECT {', '.join(keys)}, greatest(0.0, CASE WHEN cut IS NULL THEN capacity ELSE least(capacity, cut * w) END) budget FROM {name}_f {f"JOIN {name}_m USING ({', '.join(up)})" if up else f', {name}_m'})"""


def mixing(share: float, epochs: int, seed: int, languages: dict[str, float]) -> str:
    lang = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in languages.items()) + " ELSE 1.0 END"
    keys = ["domain", "lang", "source"]
    levels = ",\n  ".join(
        _level(n, keys[: i + 1], lang if i == 1 else "1.0", f"l{i}", share, epochs) for i, n in enumerate(("l1", "l2", "l3"))
    )
    return rf"""WITH doc AS (SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 4 AS VARCHAR) AS domain, lang, source,
    CAST(len(list_filter(regexp_split_to_array("text", '[\x20\x09-\x0D]+'), lambda z: z <> '')) AS BIGINT) n_tokens FROM documents),
  leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) tokens FROM doc GROUP BY ALL),
  {levels},
  t AS (SELECT domain, lang, source, CAST(floor(floor(budget) / tokens) AS INTEGER) whole, floor(budget) - floor(floor(budget) / tokens) * tokens rest FROM l3 JOIN leaf USING (domain, lang, source)),
  o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || doc_id)) upto FROM doc JOIN t USING (domain, lang, source))
  SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS INTEGER) epoch FROM o"""


def chat(start: str, end: str, controls: tuple[str, ...], learned: str, extra: list[tuple[int, int, str, str]]) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    count = lambda c, of: f"(length({of}) - length(replace({of}, {quoted(c)}, ''))) // {len(c)}"
    size = lambda of: " + ".join([f"length({of})", *(count(c, of) for c in (chr(92), *controls))])
    rows = ", ".join(f"({c}, {t}, {quoted(r)}, {quoted(x)})" for c, t, r, x in extra)
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce("text", '') x FROM (SELECT conv_id, turn, role, "text" FROM conversations UNION ALL (VALUES {rows})))
  SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn)) turns_sha256,
    CAST(coalesce(sum(length(x)) FILTER (r = '{learned}'), 0) AS BIGINT) loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn) FILTER (r = '{learned}'), '')) loss_sha256,
    CAST(sum({len(start) + len(end) + 1} + {size("r")} + {count(chr(10), "r")} + {size("x")}) AS BIGINT) formatted_chars FROM t GROUP BY conv_id"""


AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce("text", '') t, min(doc_id) OVER (PARTITION BY coalesce("text", '')) least FROM documents),
  w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda z: z <> '') w FROM d),
  l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, coalesce(good, false) good, coalesce(toxic, false) toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] f, count(*) n FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
  x AS (SELECT unnest(string_split('ABCDE', '')) c), o AS (SELECT a.c || b.c || c.c || d.c || e.c filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
  s AS (SELECT filter_order, unnest(range(1, 6)) step FROM o), r AS (SELECT m.*, filter_order, CAST(step AS INTEGER) step, instr('ABCDE', substr(filter_order, CAST(step AS INTEGER), 1)) own,
    list_bool_or(list_transform(range(1, step), lambda i: f[instr('ABCDE', substr(filter_order, CAST(i AS INTEGER), 1))])) gone FROM m, s),
  q AS (SELECT *, f[own] fails, coalesce(gone, false) went, len(list_filter(f, lambda z: z)) fs FROM r),
  a AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT went), 0) AS BIGINT) kept, CAST(coalesce(sum(n) FILTER (fails AND NOT went), 0) AS BIGINT) removed,
    CAST(coalesce(sum(n) FILTER (fails AND went), 0) AS BIGINT) redundant, CAST(coalesce(sum(n) FILTER (fails AND fs = 1), 0) AS BIGINT) unique_fails,
    CAST(coalesce(sum(n) FILTER (fails AND NOT went AND good), 0) AS BIGINT) good_lost, CAST(coalesce(sum(n) FILTER (fails AND NOT went AND toxic), 0) AS BIGINT) toxic_lost FROM q GROUP BY ALL)
  SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) shapley FROM a"""

_FIRST = rf"""runs AS (SELECT doc_id, unnest(regexp_extract_all("text", '[A-Za-z\x{{C0}}-\x{{FF}}]+')) r FROM documents),
  own AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || translate(r, '{_UP}', '{_LOW}') s, translate(r, '{_UP}', '{_LOW}') r, count(*) n FROM runs WHERE length(r) >= 5 GROUP BY ALL)"""

#: The CRC-32 of each run by a table made from its polynomial, near words by what is left without one code point.
SPELLING = rf"""WITH RECURSIVE steps AS (SELECT CAST(i AS BIGINT) i, CAST(i AS BIGINT) c, 0 k FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
  crc AS (SELECT list(c ORDER BY i) t FROM steps WHERE k = 8), {_FIRST},
  h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(octet_length(encode(s)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) h FROM own, crc),
  v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END word, n FROM h),
  w AS (SELECT word, CAST(sum(n) AS BIGINT) n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
  cut AS (SELECT word, n, pos, substr(word, 1, CAST(pos AS INTEGER)) || substr(word, CAST(pos AS INTEGER) + 2) rest FROM (SELECT word, n, unnest(range(length(word))) pos FROM w)),
  near AS (SELECT a.word, b.word nw, b.n nn FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
    UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = rest UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = rest),
  f AS (SELECT word, n, count(nw) n_near, arg_min(nw, (-nn, nw)) best, max(nn) most FROM w LEFT JOIN near USING (word) GROUP BY ALL),
  form AS (SELECT word, n, n_near, CASE WHEN most >= 2 * n THEN best END form, CASE WHEN most >= 2 * n THEN most END form_n FROM f),
  way AS (SELECT word, word "last" FROM form UNION ALL SELECT way.word, form.form FROM way JOIN form ON form.word = "last" WHERE form.form IS NOT NULL)
  SELECT word, form, "last" root, n, n_near, form_n FROM form JOIN way USING (word) WHERE "last" IN (SELECT word FROM form WHERE form IS NULL)"""
