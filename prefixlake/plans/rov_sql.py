"""SQL pieces of containment and origin validation that several queries share; they follow the projections act and vrp."""

COVER = "w.afi = t.afi AND w.plen <= t.plen AND CASE WHEN t.afi = 1 THEN w.p_lo = t.p_lo - t.p_lo % (1::BIGINT << (32 - w.plen)) ELSE w.p_hi = t.p_hi - t.p_hi % (1::BIGINT << (64 - w.plen)) END"

#: st: the status of each distinct (prefix, origin).
VALID = f"""pr AS (SELECT DISTINCT afi, plen, p_hi, p_lo, origin FROM act WHERE safi = 1 AND origin IS NOT NULL), hold AS (SELECT DISTINCT afi, plen, p_hi, p_lo, asn, max_len FROM (SELECT afi, plen, p_hi, p_lo, asn, coalesce(max_len, plen) AS max_len, arg_max(action, seq) AS action FROM vrp GROUP BY ALL) WHERE action = 'announce'),
  st AS (SELECT t.afi, t.plen, t.p_hi, t.p_lo, t.origin, CASE WHEN max(CASE WHEN w.asn = t.origin AND t.plen <= w.max_len THEN 1 ELSE 0 END) = 1 THEN 'valid' WHEN count(w.asn) > 0 THEN 'invalid' ELSE 'notFound' END AS rov FROM pr t LEFT JOIN hold w ON {COVER} GROUP BY ALL)"""

#: s1, s2: the statuses before and after a delta of VRPs, of the pairs that it touches.
HALF = f"""pr AS (SELECT DISTINCT afi, plen, p_hi, p_lo, origin FROM act WHERE safi = 1 AND origin IS NOT NULL), allv AS (SELECT DISTINCT afi, plen, p_hi, p_lo, asn, coalesce(max_len, plen) AS max_len, seq % 7 = 0 AS d FROM vrp WHERE action = 'announce'),
  bef AS (SELECT DISTINCT afi, plen, p_hi, p_lo, asn, max_len FROM allv WHERE NOT d), aft AS (SELECT DISTINCT afi, plen, p_hi, p_lo, asn, max_len FROM allv),
  delta AS (SELECT * FROM aft EXCEPT SELECT * FROM bef), tch AS (SELECT DISTINCT t.* FROM pr t JOIN delta w ON {COVER}),
  s1 AS (SELECT t.*, CASE WHEN max(CASE WHEN w.asn = t.origin AND t.plen <= w.max_len THEN 1 ELSE 0 END) = 1 THEN 'valid' WHEN count(w.asn) > 0 THEN 'invalid' ELSE 'notFound' END AS rov FROM tch t LEFT JOIN bef w ON {COVER} GROUP BY ALL),
  s2 AS (SELECT t.*, CASE WHEN max(CASE WHEN w.asn = t.origin AND t.plen <= w.max_len THEN 1 ELSE 0 END) = 1 THEN 'valid' WHEN count(w.asn) > 0 THEN 'invalid' ELSE 'notFound' END AS rov FROM tch t LEFT JOIN aft w ON {COVER} GROUP BY ALL)"""
