"""Shared CTEs of the check SQL (DuckDB dialect), in dependency order. All names start with x_."""

CTES: dict[str, str] = {}

CTES["x_cat"] = """
  SELECT CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
                     WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END::BIGINT AS category_id,
         p_type AS name,
         CASE WHEN p_type IN ('ECONOMY','PROMO') THEN 101 WHEN p_type IN ('LARGE','MEDIUM','SMALL') THEN 102 END::BIGINT AS parent_id
  FROM (SELECT DISTINCT p_type FROM part)
  UNION ALL SELECT 101::BIGINT, 'VALUE', NULL WHERE EXISTS (SELECT 1 FROM part WHERE p_type IN ('ECONOMY','PROMO'))
  UNION ALL SELECT 102::BIGINT, 'SIZED', NULL WHERE EXISTS (SELECT 1 FROM part WHERE p_type IN ('LARGE','MEDIUM','SMALL'))"""

CTES["x_prod"] = """
  SELECT p_partkey AS product_id,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
                     WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END::BIGINT AS category_id,
         trim(regexp_replace(lower(p_name || ' ' || p_partkey), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
         p_name AS name,
         CASE WHEN p_size % 4 = 0 THEN 'size ' || p_size END AS description,
         p_brand AS brand, p_retailprice AS price,
         CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice * 0.8::DOUBLE, 2)
              WHEN p_partkey % 11 = 1 THEN round(p_retailprice * 1.1::DOUBLE, 2) END AS sale_price,
         CASE WHEN p_partkey % 3 = 0 THEN 20.0 WHEN p_partkey % 11 = 1 THEN 5.0 END::DOUBLE AS discount_percentage,
         (p_partkey % 8)::BIGINT AS stock_quantity,
         CASE WHEN p_size % 5 = 0 THEN 'grade ' || p_brand END AS ingredients,
         p_partkey % 17 <> 0 AS is_active
  FROM part"""

CTES["x_tagword"] = """
  SELECT p_partkey AS product_id, word, ('0x' || substr(md5(word), 1, 8))::BIGINT AS tag_id
  FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)"""

CTES["x_catalog"] = """
  SELECT p.*, c.name AS category_name, q.name AS parent_category_name,
         CASE WHEN p.sale_price > 0 AND p.sale_price < p.price THEN p.sale_price ELSE p.price END AS effective_price,
         coalesce(p.sale_price > 0 AND p.sale_price < p.price, false) AS is_discounted
  FROM x_prod p LEFT JOIN x_cat c ON p.category_id = c.category_id LEFT JOIN x_cat q ON c.parent_id = q.category_id"""

CTES["x_bounds"] = """
  SELECT quantile_cont(effective_price, 1/3::DOUBLE) AS tier_lower, quantile_cont(effective_price, 2/3::DOUBLE) AS tier_upper,
         median(effective_price) AS median_price, stddev_pop(effective_price) AS std_price, max(price) AS max_price
  FROM x_catalog"""

CTES["x_catprice"] = """
  SELECT category_name, median(effective_price) AS median_price, stddev_pop(effective_price) AS std_price
  FROM x_catalog WHERE category_name IS NOT NULL GROUP BY 1"""

CTES["x_users"] = """
  SELECT u.user_id, u.age_group, c.name AS preferred_category FROM (
    SELECT c_custkey AS user_id, c_mktsegment AS age_group,
           CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN 999
                ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 6 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3
                                       WHEN 'HOUSEHOLD' THEN 5 WHEN 'FURNITURE' THEN 1 END END AS pref
    FROM customer) u LEFT JOIN x_cat c ON u.pref = c.category_id"""

CTES["x_log"] = """
  SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS product_id,
         CASE event_type WHEN 'view' THEN 'CLICK' WHEN 'click' THEN 'ADD_TO_CART' WHEN 'purchase' THEN 'PURCHASE'
                         WHEN 'signup' THEN 'SEARCH' WHEN 'error' THEN 'CHATBOT' END AS action_type,
         CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'cart' WHEN 'purchase' THEN 'purchase'
                         WHEN 'signup' THEN 'search' WHEN 'error' THEN 'chatbot' END AS signal,
         ts AS action_time
  FROM events"""

CTES["x_weights"] = """
  SELECT * FROM (VALUES ('click', 0.1::DOUBLE), ('purchase', 0.45::DOUBLE), ('cart', 0.25::DOUBLE),
                        ('search', 0.15::DOUBLE), ('chatbot', 0.15::DOUBLE)) AS t(signal, base)"""

CTES["x_reviews"] = """
  SELECT o_custkey AS user_id, l_partkey AS product_id, (1 + l_linenumber % 5)::DOUBLE AS rating, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

CTES["x_relprice"] = """
  SELECT product_id, CASE WHEN category_name IS NULL OR count(*) OVER (PARTITION BY category_name) = 1 THEN 0.5
                          ELSE cume_dist() OVER (PARTITION BY category_name ORDER BY effective_price) END AS category_relative_price
  FROM x_catalog"""

CTES["x_pf"] = """
  SELECT c.*, CASE WHEN effective_price <= tier_lower THEN 'budget' WHEN effective_price <= tier_upper THEN 'mid' ELSE 'premium' END AS price_tier,
         rp.category_relative_price,
         coalesce(p.purchase_count, 0) AS purchase_count, coalesce(p.distinct_purchasers, 0) AS distinct_purchasers,
         coalesce(k.cart_add_count, 0) AS cart_add_count, coalesce(v.review_count, 0) AS review_count, v.average_rating,
         (is_active AND stock_quantity > 0) AS eligible
  FROM x_catalog c CROSS JOIN x_bounds JOIN x_relprice rp USING (product_id)
  LEFT JOIN (SELECT product_id, count(*) AS purchase_count, count(DISTINCT user_id) AS distinct_purchasers FROM x_log WHERE action_type = 'PURCHASE' GROUP BY 1) p USING (product_id)
  LEFT JOIN (SELECT product_id, count(*) AS cart_add_count FROM x_log WHERE action_type = 'ADD_TO_CART' GROUP BY 1) k USING (product_id)
  LEFT JOIN (SELECT product_id, avg(rating) AS average_rating, count(*) AS review_count FROM x_reviews GROUP BY 1) v USING (product_id)"""

# --- examples: one row per feature build. x_ex(example_id, user_id, cutoff) ---------------------
CTES["x_purch"] = "SELECT event_id, user_id, product_id, action_time FROM x_log WHERE action_type = 'PURCHASE' AND action_time IS NOT NULL"

CTES["x_ranked"] = """
  SELECT user_id, action_time, row_number() OVER (PARTITION BY user_id ORDER BY action_time DESC, event_id DESC) AS rn,
         count(*) OVER (PARTITION BY user_id) AS n FROM x_purch"""

CTES["x_split"] = """
  SELECT u.user_id,
         CASE WHEN coalesce(p.n, 0) >= 3 THEN 'FULL' WHEN p.n = 2 THEN 'VAL_ONLY' WHEN p.n = 1 THEN 'INSUFFICIENT_DEPTH'
              WHEN e.user_id IS NOT NULL THEN 'ENGAGEMENT_NO_PURCHASE' ELSE 'NO_HISTORY' END AS tier,
         CASE WHEN p.n >= 3 THEN p.t2 WHEN p.n = 2 THEN p.t1 END AS val_cutoff,
         CASE WHEN p.n >= 3 THEN p.t1 END AS test_cutoff,
         coalesce(p.n, 0) AS total_purchases
  FROM x_users u
  LEFT JOIN (SELECT user_id, max(n) AS n, max(action_time) FILTER (rn = 1) AS t1, max(action_time) FILTER (rn = 2) AS t2 FROM x_ranked GROUP BY 1) p USING (user_id)
  LEFT JOIN (SELECT DISTINCT user_id FROM x_log) e USING (user_id)"""

CTES["x_target"] = """
  SELECT DISTINCT s.user_id, 'val' AS split, p.product_id FROM x_split s JOIN x_purch p USING (user_id)
  WHERE p.action_time >= s.val_cutoff AND (s.test_cutoff IS NULL OR p.action_time < s.test_cutoff)
  UNION ALL
  SELECT DISTINCT s.user_id, 'test' AS split, p.product_id FROM x_split s JOIN x_purch p USING (user_id) WHERE p.action_time >= s.test_cutoff"""

CTES["x_case"] = """
  SELECT user_id * 2 + (split = 'test')::BIGINT AS example_id, user_id, split,
         CASE split WHEN 'val' THEN val_cutoff ELSE test_cutoff END AS cutoff
  FROM (SELECT DISTINCT user_id, split FROM x_target) t JOIN x_split USING (user_id)"""

CTES["x_rel"] = "SELECT user_id * 2 + (split = 'test')::BIGINT AS case_id, product_id AS item_id FROM x_target"

# History rows of every case with the decay factor of each event.
CTES["x_casehist0"] = """
  SELECT c.example_id, c.user_id, c.cutoff, l.signal, l.product_id, l.action_time
  FROM x_case c JOIN x_log l ON l.user_id = c.user_id AND l.action_time < c.cutoff"""

CTES["x_now"] = "SELECT max(action_time) AS now FROM x_log"

CTES["x_livehist0"] = """
  SELECT l.user_id AS example_id, l.user_id, n.now AS cutoff, l.signal, l.product_id, l.action_time FROM x_log l CROSS JOIN x_now n"""


def history(source: str, half_life: str = "21") -> str:
    """Chatbot rows share one time per example, the latest mention."""
    return f"""
  SELECT example_id, user_id, signal, product_id, base,
         pow(0.5::DOUBLE, (date_diff('microsecond',
             CASE WHEN signal = 'chatbot' THEN max(action_time) FILTER (signal = 'chatbot') OVER (PARTITION BY example_id) ELSE action_time END,
             cutoff) / 8.64e10::DOUBLE) / {half_life}::DOUBLE) AS w
  FROM {source} JOIN x_weights USING (signal)"""


def flat_history(source: str) -> str:
    return f"SELECT example_id, user_id, signal, product_id, base, 1.0::DOUBLE AS w FROM {source} JOIN x_weights USING (signal)"


def affinity(hist: str, examples: str, column: str) -> str:
    bonus = f"""UNION ALL SELECT e.example_id, u.preferred_category, 0.5::DOUBLE FROM {examples} e JOIN x_users u USING (user_id)
                WHERE u.preferred_category IS NOT NULL""" if column == "category_name" else ""
    return f"""
  SELECT example_id, name, v / sum(v) OVER (PARTITION BY example_id) AS weight, rn AS rank FROM (
    SELECT example_id, name, v, row_number() OVER (PARTITION BY example_id ORDER BY round(v, 12) DESC, name) AS rn FROM (
      SELECT example_id, name, sum(v) AS v FROM (
        SELECT h.example_id, c.{column} AS name, h.base * h.w AS v FROM {hist} h JOIN x_catalog c USING (product_id) WHERE c.{column} IS NOT NULL
        {bonus}) GROUP BY 1, 2)) WHERE rn <= 5"""


def user_vector(hist: str) -> str:
    return f"""
  SELECT example_id, pos, sum(eff * m) / sum(eff) AS v FROM (
    SELECT h.example_id, h.signal, e.pos, sum(h.w * e.v) / sum(h.w) AS m, max(h.base) * avg(h.w) AS eff
    FROM {hist} h JOIN x_emb e USING (product_id) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def price_profile(hist: str, examples: str) -> str:
    return f"""
  SELECT e.example_id, e.user_id,
         CASE WHEN h.n IS NOT NULL THEN h.typical WHEN cp.median_price IS NOT NULL THEN cp.median_price ELSE b.median_price END AS typical_price,
         CASE WHEN h.n IS NOT NULL THEN h.spread WHEN cp.median_price IS NOT NULL THEN cp.std_price ELSE b.std_price END AS price_spread,
         coalesce(h.n, 0) AS supporting_purchase_count,
         CASE WHEN h.n IS NOT NULL THEN 'purchase_history' WHEN cp.median_price IS NOT NULL THEN 'preferred_category_prior' ELSE 'catalog_prior' END AS fallback_source,
         b.tier_lower, b.tier_upper
  FROM {examples} e LEFT JOIN x_users u USING (user_id) CROSS JOIN x_bounds b
  LEFT JOIN x_catprice cp ON cp.category_name = u.preferred_category
  LEFT JOIN (SELECT example_id, sum(w * effective_price) / sum(w) AS typical, stddev_pop(effective_price) AS spread, count(*) AS n
             FROM {hist} JOIN x_catalog USING (product_id) WHERE signal = 'purchase' GROUP BY 1) h ON h.example_id = e.example_id"""


def counts(hist: str, examples: str) -> str:
    return f"""
  SELECT e.example_id, e.user_id,
         count(*) FILTER (signal = 'click') AS click_count, count(*) FILTER (signal = 'purchase') AS purchase_count,
         count(DISTINCT h.product_id) FILTER (signal = 'purchase') AS distinct_products_purchased,
         count(*) FILTER (signal = 'cart') AS cart_item_count, count(*) FILTER (signal = 'search') AS search_count,
         count(*) FILTER (signal = 'chatbot') > 0 AS has_chatbot_context,
         count(*) FILTER (signal IN ('click','purchase','cart','search')) + (count(*) FILTER (signal = 'chatbot') > 0)::BIGINT AS total_engagement_events
  FROM {examples} e LEFT JOIN {hist} h USING (example_id) GROUP BY 1, 2"""


CTES["x_emb"] = "SELECT vec_id AS product_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings"
CTES["x_vecs"] = "SELECT vec_id AS product_id, embedding::DOUBLE[] AS vec FROM embeddings"

CTES["x_live"] = "SELECT user_id AS example_id, user_id FROM x_users"
CTES["x_livehist"] = history("x_livehist0")
CTES["x_casehist"] = history("x_casehist0")
CTES["x_caseflat"] = flat_history("x_casehist0")

for _tag, _hist, _ex in (("live", "x_livehist", "x_live"), ("case", "x_casehist", "x_case"), ("flat", "x_caseflat", "x_case")):
    CTES[f"x_{_tag}cat"] = affinity(_hist, _ex, "category_name")
    CTES[f"x_{_tag}brand"] = affinity(_hist, _ex, "brand")
    CTES[f"x_{_tag}vec"] = user_vector(_hist)
    CTES[f"x_{_tag}vecs"] = f"SELECT example_id, list(v ORDER BY pos) AS vec FROM x_{_tag}vec GROUP BY 1"
    CTES[f"x_{_tag}price0"] = price_profile(_hist, _ex)
    CTES[f"x_{_tag}price"] = (
        "SELECT *, CASE WHEN typical_price <= tier_lower THEN 'budget' WHEN typical_price <= tier_upper THEN 'mid' "
        f"ELSE 'premium' END AS price_tier FROM x_{_tag}price0")
    CTES[f"x_{_tag}counts"] = counts(_hist, _ex)
