"""DuckDB SQL giving the result each query must have."""

from __future__ import annotations

import re

from pickwell.plans.views import DAY_MS, FIRST_DAY, NOW, RANK, with_views

ORACLES: dict[str, str] = {}

PULL = 80


def _sql(name: str, views: str, body: str) -> None:
    """``body`` starts with further ``name AS (...)`` parts or with SELECT."""
    names = views.split()
    body = body.strip()
    if body.startswith("SELECT"):
        ORACLES[name] = f"{with_views(names)}\n{body}" if names else body
    else:
        ORACLES[name] = f"{with_views(names)},\n{body}" if names else f"WITH {body}"


# Parsing

_PARSED = """fields AS (SELECT list_transform(string_split(regexp_replace(value, ',+$', ''), ','),
    lambda x: TRY_CAST(x AS DOUBLE)) AS f FROM raw_lines),
parsed AS (SELECT len(f) >= 3 AND len(list_filter(f, lambda x: x IS NULL)) = 0 AS good,
    CAST(trunc(f[1]) AS INT) AS "user", CAST(trunc(f[2]) AS INT) AS item,
    f[3] + 2 * coalesce(list_sum(f[4:]), 0) AS rating FROM fields),
ratings AS (SELECT "user", item, rating FROM parsed WHERE good)"""

_sql("parse_ratings_drop", "raw_lines", f"{_PARSED} SELECT * FROM ratings")
_sql("parse_ratings_default", "raw_lines", f"""{_PARSED} SELECT CASE WHEN good THEN "user" ELSE 0 END AS "user",
    CASE WHEN good THEN item ELSE 0 END AS item,
    CAST(CASE WHEN good THEN rating ELSE 0 END AS DOUBLE) AS rating FROM parsed""")
_sql("custom_parser", "raw_lines", f'{_PARSED} SELECT "user", item, rating / 2 AS rating FROM ratings')
_sql("triples_to_ratings", "triples",
     'SELECT CAST(u AS INT) AS "user", CAST(i AS INT) AS item, CAST(r AS DOUBLE) AS rating FROM triples')
_sql("id_list_codec", "bought", """SELECT "user", string_agg(CAST(item AS STRING), ',' ORDER BY pos) AS ids,
    CAST(count(*) AS INT) AS n, CAST(sum(item) AS BIGINT) AS total FROM bought GROUP BY 1""")

# Factors

_ELEMENTS = "generate_subscripts({f}, 1) - 1"


def _elements(keys: str, source: str, column: str = "features") -> str:
    return f"""SELECT {keys}, CAST(generate_subscripts({column}, 1) - 1 AS INT) AS pos,
        unnest({column}) AS value FROM {source}"""


_sql("valid_features", "updates", f"SELECT seq, coalesce(len(feature) = {RANK}, false) AS valid FROM updates")
_sql("factor_lookup", "user_ids batch_users", f"""e AS ({_elements('id', 'batch_users')})
    SELECT u.id, e.pos, e.value FROM user_ids u LEFT JOIN e ON u.id = e.id""")
_sql("item_factor_lookup", "item_ids speed_items", f"""e AS ({_elements('id', 'speed_items')})
    SELECT u.id, e.pos, e.value FROM item_ids u LEFT JOIN e ON u.id = e.id""")
_sql("has_users", "user_ids batch_users",
     "SELECT id, id IN (SELECT id FROM batch_users) AS known FROM user_ids")
_sql("has_items", "item_ids speed_items",
     "SELECT id, id IN (SELECT id FROM speed_items) AS known FROM item_ids")
_sql("user_ids", "whole_users", "SELECT id FROM whole_users")
_sql("item_ids", "whole_items", "SELECT id FROM whole_items")
_sql("drop_null", "requests", 'SELECT * FROM requests WHERE "user" IS NOT NULL AND per_page IS NOT NULL')
_sql("model_summary", "batch_users batch_items speed_users speed_items", " UNION ALL ".join(
    f"SELECT '{m}' AS model, '{s}' AS side, count(*) AS n FROM {m}_{s}"
    for m in ("batch", "speed") for s in ("users", "items")))
_sql("resolve_factors", "user_ids batch_users speed_users", f"""r AS (SELECT u.id,
    CASE WHEN b.id IS NOT NULL THEN b.features ELSE s.features END AS features FROM user_ids u
    LEFT JOIN batch_users b ON u.id = b.id LEFT JOIN speed_users s ON u.id = s.id
    WHERE b.id IS NOT NULL OR s.id IS NOT NULL) {_elements('id', 'r')}""")
_sql("prune_speed", "batch_users batch_items speed_users speed_items", " UNION ALL ".join(
    _elements(f"'{s}' AS side, id", f"speed_{s} WHERE id NOT IN (SELECT id FROM batch_{s})") for s in ("users", "items")))
_MERGE = """m AS (SELECT '{s}' AS side, coalesce(o.id, n.id) AS id, o.id IS NULL AS is_new,
    CASE WHEN o.id IS NULL THEN n.features WHEN n.id IS NULL THEN o.features
    ELSE list_transform(range(1, len(o.features) + 1), lambda i: n.features[i] * CAST(0.8 AS DOUBLE)
    + o.features[i] * (1 - CAST(0.8 AS DOUBLE))) END AS features
    FROM batch_{s} o FULL JOIN speed_{s} n ON o.id = n.id)"""
_sql("merge_models", "batch_users batch_items speed_users speed_items",
     _MERGE.format(s="users").replace("m AS", "mu AS", 1) + ",\n" + _MERGE.format(s="items").replace("m AS", "mi AS", 1)
     + f" {_elements('side, id, is_new', 'mu')} UNION ALL {_elements('side, id, is_new', 'mi')}")
_sql("recent_new", "batch_users batch_items speed_users speed_items", " UNION ALL ".join(
    f"SELECT '{s}' AS side, id FROM speed_{s} WHERE id NOT IN (SELECT id FROM batch_{s})" for s in ("users", "items")))
_sql("as_speed_model", "whole_items", _elements("id", "whole_items"))

# Scoring


def _top(source: str, target: str, k: int, key: str = "user", other: str = "item") -> str:
    return f"""SELECT key AS "{key}", CAST(place AS INT) AS rank, other AS {other}, score FROM (
        SELECT s.id AS key, t.id AS other, list_dot_product(s.features, t.features) AS score,
        row_number() OVER (PARTITION BY s.id ORDER BY list_dot_product(s.features, t.features) DESC, t.id) AS place
        FROM {source} s, {target} t) WHERE place <= {k}"""


def _rank(rows: str, key: str, other: str, limit: int | None = None) -> str:
    where = "" if limit is None else f" WHERE rank <= {limit}"
    return f"""SELECT * FROM (SELECT "{key}", CAST(row_number() OVER (
        PARTITION BY "{key}" ORDER BY score DESC, "{other}") AS INT) AS rank, "{other}", score
        FROM ({rows})){where}"""


_KNOWN_USERS = "su AS (SELECT * FROM {m}_users WHERE id IN (SELECT id FROM {ids}))"
_KNOWN_ITEMS = "si AS (SELECT * FROM {m}_items WHERE id IN (SELECT id FROM {ids}))"

_sql("predict_pairs", "pairs batch_users batch_items", """SELECT p."user", p.item,
    list_dot_product(u.features, v.features) AS score FROM pairs p
    JOIN batch_users u ON p."user" = u.id JOIN batch_items v ON p.item = v.id""")
for _m, _prefix in (("whole", ""), ("speed", "speed_")):
    _sql(f"{_prefix}items_for_features", f"vectors {_m}_items", _top("vectors", f"{_m}_items", 20))
    _sql(f"{_prefix}users_for_features", f"vectors {_m}_users", _top("vectors", f"{_m}_users", 20, "item", '"user"'))
_sql("items_for_users_subset", "event_users batch_users batch_items",
     _KNOWN_USERS.format(m="batch", ids="event_users") + " " + _top("su", "batch_items", 50))
_sql("users_for_items_subset", "item_ids batch_users batch_items",
     _KNOWN_ITEMS.format(m="batch", ids="item_ids") + " " + _top("si", "batch_users", 10, "item", '"user"'))
_sql("items_for_all_users", "whole_users whole_items", _top("whole_users", "whole_items", 10))
ORACLES["items_for_all_users_grid"] = ORACLES["items_for_all_users"]
_sql("users_for_all_items", "whole_users whole_items", _top("whole_items", "whole_users", 10, "item", '"user"'))
_sql("items_for_factor_table", "speed_users batch_items", _top("speed_users", "batch_items", 10))
_sql("speed_items_for_users", "user_ids speed_users speed_items",
     _KNOWN_USERS.format(m="speed", ids="user_ids") + " " + _top("su", "speed_items", 10))
_sql("speed_users_for_items", "item_ids speed_users speed_items",
     _KNOWN_ITEMS.format(m="speed", ids="item_ids") + " " + _top("si", "speed_users", 10, "item", '"user"'))

_ALL = "batch_users batch_items speed_users speed_items"
_sql("merged_topn_bulk", _ALL, f"""a AS ({_top('speed_users', 'batch_items', 25)}),
    b AS ({_top('speed_users', 'speed_items', 25)})
    {_rank('SELECT * FROM a UNION ALL SELECT * FROM b', 'user', 'item', 25)}""")
_sql("merged_topn_bulk_best", _ALL, f"""v AS (SELECT s.id, coalesce(b.features, s.features) AS features
    FROM speed_users s LEFT JOIN batch_users b ON s.id = b.id),
    both_items AS (SELECT id, features FROM batch_items UNION ALL SELECT id, features FROM speed_items),
    best AS (SELECT v.id AS "user", t.id AS item, max(list_dot_product(v.features, t.features)) AS score
    FROM v, both_items t GROUP BY 1, 2) {_rank('SELECT * FROM best', 'user', 'item', 25)}""")
_sql("merged_topn_users", f"event_users {_ALL}", f"""{_KNOWN_USERS.format(m='batch', ids='event_users')},
    sp AS (SELECT * FROM speed_users WHERE id IN (SELECT id FROM event_users)),
    a AS ({_top('su', 'batch_items', 100)}), b AS ({_top('sp', 'speed_items', 100)})
    {_rank('SELECT * FROM a UNION ALL SELECT * FROM b', 'user', 'item', 100)}""")
_sql("serve_items", f"user_ids {_ALL}", f"""v AS (SELECT u.id, coalesce(b.features, s.features) AS features
    FROM user_ids u LEFT JOIN batch_users b ON u.id = b.id LEFT JOIN speed_users s ON u.id = s.id
    WHERE b.id IS NOT NULL OR s.id IS NOT NULL),
    a AS ({_top('v', 'speed_items', 15)}), b AS ({_top('v', 'batch_items', 15)})
    {_rank('SELECT * FROM a UNION ALL SELECT * FROM b', 'user', 'item')}""")
_sql("serve_users", f"item_ids {_ALL}", f"""v AS (SELECT u.id, coalesce(b.features, s.features) AS features
    FROM item_ids u LEFT JOIN batch_items b ON u.id = b.id LEFT JOIN speed_items s ON u.id = s.id
    WHERE b.id IS NOT NULL OR s.id IS NOT NULL),
    a AS ({_top('v', 'speed_users', 10, 'item', '"user"')}), b AS ({_top('v', 'batch_users', 10, 'item', '"user"')})
    {_rank('SELECT * FROM a UNION ALL SELECT * FROM b', 'item', 'user')}""")

# Recommenders of the caller's own


def _taste(name: str, where: str, part: str = "0") -> str:
    """Members and scores of groups by taste, from the lines that ``where`` names; ``part`` splits users into models."""
    parsed = _PARSED.replace("FROM raw_lines", f"FROM raw_lines WHERE {where}")
    for part_of in ("fields", "parsed", "ratings"):
        parsed = re.sub(rf"\b{part_of}\b", f"{part_of}_{name}", parsed)
    return f"""{parsed},
m_{name} AS (SELECT "user", {part} AS part, CAST(floor(avg(rating) / 4) AS INT) AS grp FROM ratings_{name} GROUP BY 1),
s_{name} AS (SELECT part, grp, item, sum(rating) AS score FROM ratings_{name} JOIN m_{name} USING ("user") GROUP BY 1, 2, 3),
i_{name} AS (SELECT *, row_number() OVER (PARTITION BY part, grp ORDER BY score DESC, item) AS place FROM s_{name}),
u_{name} AS (SELECT *, row_number() OVER (PARTITION BY part, grp ORDER BY "user") AS place FROM m_{name})"""


def _taste_items(name: str, k: int) -> str:
    return f"""(SELECT m."user", i.item, i.score FROM m_{name} m JOIN i_{name} i ON m.part = i.part AND m.grp = i.grp
        WHERE i.place <= {k})"""


def _taste_users(name: str, k: int) -> str:
    return f"""(SELECT item, "user", score FROM (SELECT s.item, u."user", s.score,
        row_number() OVER (PARTITION BY s.item ORDER BY s.score DESC, u."user") AS place
        FROM s_{name} s JOIN u_{name} u ON s.part = u.part AND s.grp = u.grp WHERE u.place <= {k}) WHERE place <= {k})"""


_TWO = f"{_taste('a', 'n <= 4')}, {_taste('b', 'n >= 4')}"
_sql("serve_own_items", "raw_lines",
     f"{_TWO} {_rank(f'SELECT * FROM {_taste_items("a", 15)} UNION ALL SELECT * FROM {_taste_items("b", 15)}', 'user', 'item')}")
_sql("serve_own_users", "raw_lines",
     f"{_TWO} {_rank(f'SELECT * FROM {_taste_users("a", 10)} UNION ALL SELECT * FROM {_taste_users("b", 10)}', 'item', 'user')}")
_sql("serve_mixed_items", "user_ids raw_lines batch_users batch_items",
     f"""{_taste('b', 'n >= 4')}, {_KNOWN_USERS.format(m='batch', ids='user_ids')}, f AS ({_top('su', 'batch_items', 15)})
     {_rank(f'SELECT "user", item, score FROM f UNION ALL SELECT * FROM {_taste_items("b", 15)}', 'user', 'item')}""")
_sql("own_items_for_features", "raw_lines", f"""{_TWO},
    v AS (SELECT "user", CAST(floor(avg(rating) / 4) AS INT) AS grp FROM ratings_b GROUP BY 1)
    SELECT v."user", CAST(i.place AS INT) AS rank, i.item, i.score FROM v JOIN i_a i ON v.grp = i.grp WHERE i.place <= 8""")
_LISTED = """SELECT "user", string_agg(CAST(item AS STRING), ',' ORDER BY rank) AS ids FROM r GROUP BY 1"""
_sql("speed_layer_own", "raw_lines", f"""{_taste('a', 'n <= 4')}, {_taste('b', 'true', '"user" % 3')},
    best AS (SELECT "user", item, max(score) AS score FROM (SELECT * FROM {_taste_items('a', 12)}
    WHERE "user" IN (SELECT "user" FROM m_b) UNION ALL SELECT * FROM {_taste_items('b', 12)}) GROUP BY 1, 2),
    r AS ({_rank('SELECT * FROM best', 'user', 'item', 12)}) {_LISTED}""")
_sql("speed_restart", "raw_lines", f"""{_taste('b', 'true')},
    r AS (SELECT m."user", i.item, i.place AS rank FROM m_b m JOIN i_b i ON m.grp = i.grp
    WHERE i.place <= CASE WHEN m."user" < 60 THEN 7 ELSE 12 END) {_LISTED}""")

# Training and versions

_IDS = """SELECT DISTINCT 'users' AS side, "user" AS id FROM ratings
    UNION ALL SELECT DISTINCT 'items', item FROM ratings"""
_sql("als_factor_ids", "raw_lines", f"{_PARSED} {_IDS}")
for _name, _key in (("train_als", "user"), ("train_als_by_sums", "item")):
    _sql(_name, "raw_lines", f'{_PARSED} SELECT "{_key}" AS id, count(*) AS n, true AS at_rest, true AS learned FROM ratings GROUP BY 1')
_NEWEST = """months AS (SELECT DISTINCT date_trunc('month', ordered) AS m FROM raw_lines ORDER BY m DESC LIMIT 10),
newest_lines AS (SELECT value FROM raw_lines WHERE date_trunc('month', ordered) IN (SELECT m FROM months))"""
_sql("run_batch_training", "raw_lines",
     f"{_NEWEST},\n{_PARSED.replace('FROM raw_lines', 'FROM newest_lines')} {_IDS}")
_sql("save_load_model", "whole_users whole_items",
     _elements("'users' AS side, id", "whole_users") + " UNION ALL " + _elements("'items' AS side, id", "whole_items"))
ORACLES["follow_models"] = ORACLES["save_load_model"]
_sql("persist_model", "whole_users whole_items", """SELECT * FROM (VALUES ('new', false, false, CAST(NULL AS BIGINT)),
    ('held', true, true, NULL), ('swapped', false, true, NULL), ('released', false, false, NULL)) v(step, users, items, n)
    UNION ALL SELECT 'users', NULL, NULL, count(*) FROM whole_users UNION ALL SELECT 'items', NULL, NULL, count(*) FROM whole_items""")
_sql("latest_model", "lines", "SELECT strftime(max(ordered), '%Y%m%d') AS path FROM lines")

# Lines in and out

_sql("read_latest", "raw_lines", f"{_NEWEST} SELECT value, count(*) AS n FROM newest_lines GROUP BY 1")
_sql("land_stream", "raw_lines", """SELECT strftime(date_trunc('year', ordered), '%Y%m%d') AS day, '00' AS hour,
    value, count(*) AS n FROM raw_lines GROUP BY 1, 2, 3""")
_sql("folded_hours", "raw_lines", """SELECT strftime(date_trunc('year', ordered), '%Y%m%d') AS day, '00' AS hour,
    value, count(*) AS n, true AS few_files, CAST(1 AS BIGINT) AS n_folders FROM raw_lines GROUP BY 1, 2, 3""")
_sql("read_messages", "raw_lines",
     "SELECT value, count(*) AS n_stream, count(*) AS n_batch FROM raw_lines GROUP BY 1")

# Keyed tables

_sql("upsert", "lines", """totals AS (SELECT CAST(cust AS INT) AS "user", order_status AS status,
    CAST(sum(q) AS BIGINT) AS total, row_number() OVER (PARTITION BY cust ORDER BY order_status DESC) AS back
    FROM lines GROUP BY cust, order_status)
    SELECT "user", status, total FROM totals WHERE back = 1 AND total >= 150""")
_sql("write_lists", _ALL, f"""a AS ({_top('batch_users', 'batch_items', 10)}),
    b AS ({_top('speed_users', 'speed_items', 10)}),
    c AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE "user" NOT IN (SELECT id FROM batch_users))
    SELECT "user", string_agg(CAST(item AS STRING), ',' ORDER BY rank) AS ids FROM c GROUP BY 1""")
_sql("upsert_duplicates", "lines", """SELECT CAST(cust AS INT) AS "user",
    CAST(max(part * 10000 + q * 100 + n) AS BIGINT) AS "at" FROM lines GROUP BY cust""")
_sql("upsert_restart", "lines", """SELECT CAST(cust AS INT) AS "user", CASE WHEN bool_or(order_status = 'P') THEN 'P'
    WHEN bool_or(order_status = 'O') THEN 'O' ELSE 'F' END AS status FROM lines GROUP BY cust""")
_sql("register_candidate", "registry", """SELECT name,
    CASE candidate_list_type WHEN 'list' THEN 'tables' ELSE 'again' END AS url FROM registry""")

_sql("catalog_tables", "lines", """SELECT 'row' AS step, true AS found, CAST(cust AS INT) AS "user",
    CAST(2 * sum(q) AS BIGINT) AS twice FROM lines GROUP BY cust UNION ALL SELECT step, found, NULL, NULL
    FROM (VALUES ('before', false), ('created', true), ('dropped', true), ('after', false), ('again', false)) v(step, found)""")

# Candidates

_sql("resolve_candidate", "registry", """SELECT cid, name, store_type = 'hbase' AND (candidate_list_type = 'list'
    OR (candidate_list_type = 'mode' AND algo = 'als')) AS accepted FROM registry""")
_sql("add_candidate", "registry", """SELECT cid, name FROM registry UNION ALL
    SELECT CAST((SELECT max(cid) FROM registry) + row_number() OVER (ORDER BY s_name) AS INT), s_name FROM supplier""")
_sql("remove_candidate", "registry", "SELECT cid, name FROM registry WHERE store_type <> 'jdbc'")
_sql("candidate_params", "user_ids cids params", """SELECT u.id AS "user", c.cid, p.weight, p."offset"
    FROM user_ids u CROSS JOIN cids c LEFT JOIN params p ON u.id = p."user" AND c.cid = p.cid""")


def _quota(num: int) -> str:
    return f"""quota AS (SELECT u.id AS "user", c.cid, CAST(CASE WHEN p.weight IS NOT NULL
        THEN trunc({num} * p.weight) ELSE trunc((CAST(1 AS DOUBLE) / (SELECT count(*) FROM cids)) * {num}) END AS INT)
        AS num, coalesce(p."offset", '0') AS "offset" FROM user_ids u CROSS JOIN cids c
        LEFT JOIN params p ON u.id = p."user" AND c.cid = p.cid)"""


_PULLED = _quota(PULL) + """,
mode_units AS (SELECT b."user", b.item, q.cid, b.pos - 1 AS pos FROM bought b JOIN quota q
    ON b."user" = q."user" AND q.cid = 1 AND b.pos <= q.num),
list_units AS (SELECT q."user", t.item, q.cid, CAST(CAST(t.rank_key AS INT) - CAST(q."offset" AS INT) AS INT) AS pos
    FROM top_list t JOIN quota q ON q.cid = 2 AND t.rank_key >= lpad(q."offset", 5, '0')
    AND t.rank_key < lpad(CAST(CAST(q."offset" AS INT) + q.num AS STRING), 5, '0')),
units AS (SELECT * FROM mode_units UNION ALL SELECT * FROM list_units)"""
_PULL_VIEWS = "user_ids cids params bought top_list"
_sql("quotas", "user_ids cids params", f"{_quota(2000)} SELECT * FROM quota")
_sql("pull_model", _PULL_VIEWS, f"{_PULLED} SELECT * FROM mode_units")
_sql("pull_top", _PULL_VIEWS, f"{_PULLED} SELECT * FROM list_units")
_sql("pull_all", _PULL_VIEWS, f"{_PULLED} SELECT * FROM units")
ORACLES["open_sources"] = ORACLES["pull_all"]
_sql("rank_keys", "lines", """t AS (SELECT CAST(cust AS INT) AS "user", sum(q) AS num FROM lines GROUP BY 1)
    SELECT "user", printf('%05d', CAST(num + 12 AS INT)) AS near, printf('%05d', CAST(num + 99999 AS INT)) AS far
    FROM t""")
_sql("save_params", _PULL_VIEWS, f"""{_PULLED} SELECT q."user", q.cid, p.weight, CASE q.cid WHEN 1 THEN q."offset"
    ELSE printf('%05d', CAST(q."offset" AS INT) + q.num) END AS "offset" FROM quota q
    JOIN params p ON q."user" = p."user" AND q.cid = p.cid""")

# Fusion

_FUSED = _PULLED + """,
fused AS (SELECT "user", item, string_agg(CAST(cid AS STRING), ',' ORDER BY cid) AS cids,
    CAST(count(*) AS INT) AS n_sources FROM units GROUP BY 1, 2)"""


def _ranked(seed: int, name: str) -> str:
    return f"""{name}_x AS (SELECT *, (CAST("user" AS BIGINT) * 73856093 + CAST(item AS BIGINT) * 19349663
        + {seed * 83492791}) % 2147483647 AS x FROM fused),
    {name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY "user" ORDER BY n_sources DESC,
        ((x * x) % 2147483647 * 48271 + x) % 2147483647, item) AS INT) AS rank FROM {name}_x)"""


_sql("fuse", _PULL_VIEWS, f'{_FUSED} SELECT "user", item, cids, n_sources FROM fused')
ORACLES["fuse_known"] = ORACLES["fuse"]
_sql("rank_fused", _PULL_VIEWS, f'{_FUSED}, {_ranked(7, "r")} SELECT "user", item, n_sources, rank FROM r')
_sql("rank_fused_custom", _PULL_VIEWS, f"""{_FUSED} SELECT "user", item, CAST(row_number() OVER (
    PARTITION BY "user" ORDER BY item) AS INT) AS rank FROM fused""")
_sql("append_history", _PULL_VIEWS, f"""{_FUSED}, {_ranked(7, "r")}, {_ranked(8, "s")},
    h AS (SELECT 7 AS run, r."user", u.cid, r.rank, r.item FROM r JOIN units u
    ON r."user" = u."user" AND r.item = u.item UNION ALL
    SELECT 8, s."user", u.cid, s.rank, s.item FROM s JOIN units u ON s."user" = u."user" AND s.item = u.item)
    SELECT "user", cid, CAST(row_number() OVER (PARTITION BY "user", cid ORDER BY run, rank, item) AS INT) AS pos,
    item FROM h""")
_sql("serving_list", _PULL_VIEWS, f"""{_FUSED}, {_ranked(7, "r")} SELECT "user",
    string_agg(CAST(item AS STRING), ',' ORDER BY rank) AS ids, CAST({NOW} AS BIGINT) AS update_time,
    CAST(0 AS INT) AS "offset" FROM r GROUP BY 1""")
_MOVED = """SELECT 'params' AS part, q."user", q.cid, NULL AS pos, NULL AS item, CASE q.cid WHEN 1 THEN q."offset"
    WHEN 2 THEN printf('%05d', CAST(q."offset" AS INT) + q.num) END AS text, p.weight FROM quota q
    JOIN params p ON q."user" = p."user" AND q.cid = p.cid"""


def _refresh(lists: str, history: str) -> str:
    return f"""SELECT 'list' AS part, "user", NULL AS cid, NULL AS pos, NULL AS item,
        string_agg(CAST(item AS STRING), ',' ORDER BY rank) AS text, CAST(NULL AS DOUBLE) AS weight FROM {lists} GROUP BY 2
        UNION ALL SELECT 'history', "user", cid, pos, item, NULL, NULL FROM ({history}) UNION ALL {_MOVED}"""


_GIVEN = """SELECT {run} AS run, {r}."user", u.cid, {r}.rank AS pos, {r}.item FROM {r} JOIN units u
    ON {r}."user" = u."user" AND {r}.item = u.item"""
_sql("refresh_lists", _PULL_VIEWS, f"{_FUSED}, {_ranked(7, 'r')} {_refresh('r', _GIVEN.format(run=1, r='r'))}")
_sql("store_refresh", _PULL_VIEWS, f"""{_FUSED}, {_ranked(7, 'r')}, {_ranked(8, 's')}, h AS ({_GIVEN.format(run=1, r='r')}
    UNION ALL {_GIVEN.format(run=2, r='s')}), n AS (SELECT "user", cid, CAST(row_number() OVER (PARTITION BY "user", cid
    ORDER BY run, pos, item) AS INT) AS pos, item FROM h) {_refresh('s', 'SELECT * FROM n')}""")

# Paging and cache

_ASKED = """asked AS (SELECT seq, "user", CASE WHEN page IS NULL OR per_page IS NULL THEN 1 ELSE page END AS page,
    CASE WHEN page IS NULL OR per_page IS NULL THEN 10 ELSE per_page END AS per_page, "user" IS NOT NULL AS valid
    FROM requests),
ok AS (SELECT * FROM asked WHERE valid)"""
_STORED = """sl AS (SELECT "user", any_value("offset") AS "offset", list(item ORDER BY pos) AS items,
    CAST(count(*) AS INT) AS len FROM stored GROUP BY 1)"""
_CACHED = """cl AS (SELECT "user", any_value("offset") AS "offset", any_value(begin_time) AS begin_time,
    list(item ORDER BY pos) AS items, CAST(count(*) AS INT) AS len FROM cached GROUP BY 1)"""


def _pages(name: str, asked: str, lists: str, start: str, after: str, status: str) -> str:
    return f"""{name} AS (SELECT seq, "user", coalesce(array_to_string(list_transform(range(st, st + per_page),
        lambda i: items[(i % len) + 1]), ','), '') AS page_items, CAST({after} AS INT) AS new_offset,
        {status} AS status FROM (SELECT a.seq, a."user", a.per_page, l.items, l.len, {start} AS st FROM (
        SELECT *, CAST(coalesce(sum(per_page) OVER (PARTITION BY "user" ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM {asked}) a
        LEFT JOIN {lists} l ON a."user" = l."user"))"""


def _stored_pages(name: str, asked: str, lists: str = "sl", refill: int = 20) -> str:
    return _pages(name, asked, lists, '(l."offset" + a.before) % l.len', "(st + per_page) % len",
                  f"""CASE WHEN len IS NULL THEN 'DatabaseFindFail' WHEN len - (st + per_page) < {refill}
                  THEN 'UpdateDatabase' ELSE 'WriterToCache' END""")


def _cached_pages(name: str, asked: str, lists: str = "cl", refill: int = 20) -> str:
    return _pages(name, asked, lists, 'least(l."offset" + a.before, l.len)', "least(st + per_page, len)",
                  f"""CASE WHEN len IS NULL THEN 'CacheFindFail' WHEN len - (st + per_page) < {refill}
                  THEN 'UpdateCache' ELSE 'ReturnList' END""")


_PAGE_VIEWS = "requests stored cached user_ids bought"
_sql("normalise_requests", "requests", f"{_ASKED} SELECT * FROM asked")
_sql("page_stored", _PAGE_VIEWS, f"""{_STORED}, once AS (SELECT CAST(id AS BIGINT) AS seq, id AS "user",
    10 AS per_page FROM user_ids), {_stored_pages('p', 'once')} SELECT * FROM p""")
_sql("page_stored_many", _PAGE_VIEWS, f"{_ASKED}, {_STORED}, {_stored_pages('p', 'ok')} SELECT * FROM p")
_sql("page_cached", _PAGE_VIEWS, f"{_ASKED}, {_CACHED}, {_cached_pages('p', 'ok')} SELECT * FROM p")
_SUMS = 'sums AS (SELECT "user", sum(per_page) AS n FROM ok GROUP BY 1)'
_sql("advance_stored", _PAGE_VIEWS, f"""{_ASKED}, {_STORED}, {_SUMS} SELECT l."user",
    CAST((l."offset" + coalesce(s.n, 0)) % l.len AS INT) AS "offset" FROM sl l LEFT JOIN sums s USING ("user")""")
_sql("touch_cached", _PAGE_VIEWS, f"""{_ASKED}, {_CACHED}, {_SUMS} SELECT l."user",
    CAST(least(l."offset" + coalesce(s.n, 0), l.len) AS INT) AS "offset",
    CASE WHEN s.n IS NULL THEN l.begin_time ELSE CAST({NOW} AS BIGINT) END AS begin_time
    FROM cl l LEFT JOIN sums s USING ("user")""")
_sql("stored_lists", _PAGE_VIEWS, f"""{_ASKED}, {_STORED} SELECT "user", array_to_string(items, ',') AS ids,
    CAST(0 AS INT) AS "offset" FROM sl WHERE "user" IN (SELECT "user" FROM ok)""")
_sql("first_page", _PAGE_VIEWS, f"""{_STORED} SELECT "user", array_to_string(items[1:10], ',') AS page_items,
    len AS n_items, CAST(least(len, 10) AS INT) AS "offset" FROM sl""")
_sql("evict", _PAGE_VIEWS, f"""{_CACHED}, alive AS (SELECT *, row_number() OVER (ORDER BY begin_time, "user") AS age,
    count(*) OVER () AS size FROM cl WHERE {NOW} - begin_time <= {400 * DAY_MS})
    SELECT "user", begin_time FROM alive WHERE 300 - size >= 30 OR age > 30""")
_sql("admit", _PAGE_VIEWS, f"""{_STORED}, {_CACHED},
    newcomers AS (SELECT "user" FROM sl WHERE "user" NOT IN (SELECT "user" FROM cl)
    ORDER BY CAST(len AS BIGINT) * 100000 + "user" LIMIT greatest(1000 - (SELECT count(*) FROM cl), 0))
    SELECT "user", begin_time, array_to_string(items, ',') AS ids, "offset" FROM cl WHERE "user" NOT IN (SELECT "user" FROM sl)
    UNION ALL SELECT "user", CAST({NOW} AS BIGINT), CAST(items[1] AS STRING), CAST(0 AS INT) FROM sl
    WHERE "user" IN (SELECT "user" FROM cl) OR "user" IN (SELECT "user" FROM newcomers)""")
_sql("visible", _PAGE_VIEWS, f"""{_ASKED}, {_STORED}, {_CACHED}, {_stored_pages('p', 'ok')},
    {_cached_pages('c', 'ok')} SELECT seq, "user", status,
    CASE WHEN status IN ('Error', 'ReturnList', 'UpdateCache') THEN page_items ELSE '' END AS page_items
    FROM (SELECT * FROM p UNION ALL SELECT * FROM c)""")
_sql("format_responses", _PAGE_VIEWS, f"""{_ASKED}, {_STORED}, {_stored_pages('p', 'asked')},
    f AS (SELECT seq, coalesce(CAST("user" AS STRING), 'null') AS user_id,
    CASE WHEN "user" IS NULL OR page_items = '' THEN 'null' ELSE page_items END AS video_ids,
    CAST("user" IS NULL OR page_items = '' AS INT) AS error_code,
    CASE WHEN "user" IS NULL THEN 'ID is null' WHEN page_items = '' THEN 'This id is not in model' ELSE '' END
    AS error_reason FROM p)
    SELECT *, CAST(json_object('user_id', user_id, 'video_ids', video_ids, 'error_code', error_code,
    'error_reason', error_reason) AS STRING) AS json FROM f""")

_ANSWER = f"""{_ASKED}, {_STORED}, {_CACHED},
fl AS (SELECT "user", CAST(0 AS INT) AS "offset", list(item ORDER BY pos) AS items, CAST(count(*) AS INT) AS len
    FROM bought GROUP BY 1),
from_cache AS (SELECT * FROM ok WHERE "user" IN (SELECT "user" FROM cl)),
from_stored AS (SELECT * FROM ok WHERE "user" NOT IN (SELECT "user" FROM cl) AND "user" IN (SELECT "user" FROM sl)),
from_fresh AS (SELECT * FROM ok WHERE "user" NOT IN (SELECT "user" FROM cl)
    AND "user" NOT IN (SELECT "user" FROM sl)),
{_cached_pages('pc', 'from_cache')}, {_stored_pages('ps', 'from_stored')}, {_cached_pages('pf', 'from_fresh', 'fl', 0)},
refill AS (SELECT DISTINCT "user", status FROM (SELECT * FROM pc UNION ALL SELECT * FROM ps)
    WHERE status IN ('UpdateCache', 'UpdateDatabase'))"""
_sql("answer", _PAGE_VIEWS, f"""{_ANSWER} SELECT seq, "user", page_items, status FROM pc
    UNION ALL SELECT seq, "user", page_items, status FROM ps
    UNION ALL SELECT seq, "user", page_items, CASE status WHEN 'CacheFindFail' THEN 'Error' ELSE 'ReturnList' END FROM pf
    UNION ALL SELECT seq, "user", '', 'Error' FROM asked WHERE NOT valid""")
_sql("answer_refill", _PAGE_VIEWS, f"{_ANSWER} SELECT * FROM refill")


def _after(asked: str) -> str:
    return f'(SELECT "user", sum(per_page) AS n FROM {asked} GROUP BY 1)'


_sql("answer_state", _PAGE_VIEWS, f"""{_ANSWER},
calm AS (SELECT * FROM from_stored WHERE "user" NOT IN (SELECT "user" FROM refill WHERE status = 'UpdateDatabase')),
after AS (SELECT 'cache' AS place, "user", items, CAST(least("offset" + coalesce(s.n, 0), len) AS INT) AS "offset",
    CASE WHEN s.n IS NULL THEN begin_time ELSE CAST({NOW} AS BIGINT) END AS begin_time
    FROM cl LEFT JOIN {_after('from_cache')} s USING ("user")
    UNION ALL SELECT 'cache', "user", items, CAST(least(s.n, len) AS INT), CAST({NOW} AS BIGINT)
    FROM sl JOIN {_after('calm')} s USING ("user")
    UNION ALL SELECT 'cache', "user", items, CAST(least(s.n, len) AS INT), CAST({NOW} AS BIGINT)
    FROM fl JOIN {_after('from_fresh')} s USING ("user")
    UNION ALL SELECT 'stored', "user", items, CAST(("offset" + coalesce(s.n, 0)) % len AS INT), NULL
    FROM sl LEFT JOIN {_after('from_stored')} s USING ("user")
    UNION ALL SELECT 'stored', "user", items, CAST(0 AS INT), NULL FROM fl WHERE "user" IN (SELECT "user" FROM from_fresh))
    SELECT place, "user", array_to_string(items, ',') AS ids, "offset", begin_time FROM after""")

ORACLES["answer_stream"] = ORACLES["answer"]
_sql("answer_stream_expired", f"timed_requests {_PAGE_VIEWS}", f"""{_ANSWER},
    begun AS (SELECT "user", {FIRST_DAY} + ("user" % 10) * {DAY_MS} AS touched FROM cl),
    gaps AS (SELECT r.seq, r."user", epoch_ms(r.at) - coalesce(lag(epoch_ms(r.at)) OVER w, b.touched) > {3 * DAY_MS} AS late
    FROM timed_requests r LEFT JOIN begun b ON r."user" = b."user" WHERE r."user" IS NOT NULL
    WINDOW w AS (PARTITION BY r."user" ORDER BY r.seq)),
    gone AS (SELECT seq, coalesce(bool_or(late) OVER (PARTITION BY "user" ORDER BY seq), false) AS gone FROM gaps),
    pages AS (SELECT seq, "user", page_items, status FROM pc UNION ALL SELECT seq, "user", page_items, status FROM ps
    UNION ALL SELECT seq, "user", page_items, CASE status WHEN 'CacheFindFail' THEN 'Error' ELSE 'ReturnList' END FROM pf)
    SELECT p.seq, p."user", CASE WHEN g.gone THEN '' ELSE page_items END AS page_items,
    CASE WHEN g.gone THEN 'Error' ELSE status END AS status FROM pages p JOIN gone g ON p.seq = g.seq
    UNION ALL SELECT seq, "user", '', 'Error' FROM asked WHERE NOT valid""")

# Streams

_sql("batch_users", "raw_lines", f'{_PARSED} SELECT DISTINCT "user" AS id FROM ratings')
_LAST = f"""last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tbl, id ORDER BY seq DESC) AS back
    FROM updates WHERE tbl IN ('User', 'Item')
    AND ("option" = 'Remove' OR ("option" = 'Update' AND len(feature) = {RANK}))) WHERE back = 1)"""


def _updated(side: str, tbl: str) -> str:
    return f"""u_{side} AS (SELECT '{side}' AS side, id, features FROM whole_{side} WHERE id NOT IN (
        SELECT id FROM last WHERE tbl = '{tbl}') UNION ALL
        SELECT '{side}', id, feature FROM last WHERE tbl = '{tbl}' AND "option" = 'Update')"""


_sql("apply_factor_updates", "updates whole_users whole_items",
     f"{_LAST}, {_updated('users', 'User')}, {_updated('items', 'Item')} {_elements('side, id', 'u_users')}"
     f" UNION ALL {_elements('side, id', 'u_items')}")
_FIRST_RANK = """(SELECT len(feature) FROM updates WHERE tbl IN ('User', 'Item') AND "option" = 'Update' ORDER BY seq LIMIT 1)"""
_sql("stream_factor_updates", "updates", f"""{_LAST.replace(f"= {RANK}", f"= {_FIRST_RANK}")}, puts AS (SELECT CASE tbl WHEN 'User' THEN 'users'
    ELSE 'items' END AS side, id, feature AS features FROM last WHERE "option" = 'Update')
    {_elements('side, id', 'puts')}""")
_sql("speed_layer", "raw_lines", f'{_PARSED} SELECT DISTINCT "user", CAST(20 AS INT) AS n FROM ratings')
