"""SQL counterparts of the queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

from table_queries.adapters import TYPE_MAP

ORACLE: dict[str, str] = {}

# --- shared pieces -------------------------------------------------------------------

_TYPE = " ".join(f"WHEN event_type = '{b}' AND k % 3 = {p} THEN '{t}'" for (b, p), (t, _) in TYPE_MAP.items())
_SOURCE = " ".join(f"WHEN event_type = '{b}' AND k % 3 = {p} THEN '{s}'" for (b, p), (_, s) in TYPE_MAP.items())

CREATED = "booking.events.v1.booking.created.create"
REASSIGNED = "booking.events.v1.booking.reassigned.create"
CANCELLED = "booking.events.v1.booking.cancelled.create"
EMAIL = "booking.events.v1.notification.email.message_sent.create"
TELEGRAM = "booking.events.v1.notification.telegram.message_sent.create"
MEETING = "booking.events.v1.meeting.url_created.create"
STATUS = "unisender.events.v1.transactional.status.create"
NEW = "getstream.events.v1.message.new.create"
READ = "getstream.events.v1.message.read.create"

_QUEUE = f"""CASE
  WHEN event_type IN ('{CREATED}', 'booking.rescheduled', '{REASSIGNED}', '{CANCELLED}',
                      'booking.events.v1.booking.reminder_sent.create') THEN 'events.booking.lifecycle'
  WHEN event_type = 'booking.reminder_sent' THEN 'events.booking.reminder'
  WHEN event_type IN ('chat.created', 'chat.deleted') THEN 'events.chat.lifecycle'
  WHEN event_type = 'chat.message_sent' THEN 'events.chat.activity'
  WHEN event_type IN ('{MEETING}', 'booking.events.v1.meeting.url_deleted.create') THEN 'events.meeting.lifecycle'
  WHEN event_type IN ('{EMAIL}', '{TELEGRAM}') THEN 'events.notification.delivery'
  WHEN source LIKE 'jitsi%' THEN 'events.jitsi'
  WHEN source = 'unisender-go' AND event_type = '{STATUS}' THEN 'events.mail'
  WHEN source = 'getstream' AND event_type LIKE 'getstream.%' THEN 'events.chat'
  ELSE 'events.unrouted' END"""

# events as an event log
EV = f"""
e0 AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events),
e1 AS (
  SELECT event_id AS n, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, user_id, k, props, event_type AS base,
         CASE WHEN user_id % 10 <> 0 THEN 'b' || user_id END AS booking_id,
         CASE {_TYPE} END AS event_type, CASE {_SOURCE} END AS source,
         ts AS received_at, ts - k * INTERVAL 1 MINUTE AS occurred_at, md5(props) AS payload_hash,
         CASE WHEN event_id % 3 <> 0 THEN md5(user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d')) END AS idempotency_key,
         't' || (event_id % 97) AS trace_id
  FROM e0),
ev AS (SELECT *, {_QUEUE} AS queue FROM e1)"""

DEDUP = """
keyed AS (SELECT * FROM ev WHERE idempotency_key IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY received_at, event_id) = 1),
loose AS (SELECT * FROM ev WHERE idempotency_key IS NULL AND booking_id IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY booking_id, event_type, source, payload_hash ORDER BY received_at, event_id) = 1),
log AS (
  SELECT * FROM keyed
  UNION ALL
  SELECT * FROM loose u WHERE NOT EXISTS (
    SELECT 1 FROM keyed k WHERE k.booking_id = u.booking_id AND k.event_type = u.event_type AND k.source = u.source
      AND k.payload_hash = u.payload_hash AND (k.received_at, k.event_id) < (u.received_at, u.event_id))
  UNION ALL
  SELECT * FROM ev WHERE idempotency_key IS NULL AND booking_id IS NULL)"""

# facts of the stored events that have a booking
FX = f"""
f0 AS (
  SELECT *,
    CASE WHEN k % 4 <> 3 AND k % 5 <> 0 THEN 'org' || (k % 5) || '@x.org' END AS organizer,
    CASE WHEN k % 4 <> 3 AND user_id % 7 <> 0 THEN 'cli' || (user_id % 7) || '@x.org' END AS client,
    'cli' || (user_id % 9) || '@x.org' AS actor,
    CASE WHEN k % 6 < 2 THEN 'organizer' WHEN k % 6 < 4 THEN 'client' END AS user_role,
    'job' || user_id || '-' || (k % 4) AS job,
    CASE WHEN k % 4 <> 0 THEN 'T' || (k % 4) END AS trig,
    CASE WHEN k % 4 <> 3 THEN occurred_at END AS start_time,
    CASE WHEN k % 4 <> 3 AND k % 2 = 0 THEN received_at END AS end_time,
    CASE WHEN k % 4 <> 3 AND event_type = '{CREATED}' THEN 'created' END AS booking_status,
    source = 'getstream' OR (source = 'booking' AND contains(event_type, '.chat.')) AS is_chat,
    CASE WHEN k % 4 = 0 THEN 'organizer' WHEN k % 4 = 1 THEN 'client' END AS video_role,
    CASE event_type WHEN '{NEW}' THEN 'message.new' WHEN '{READ}' THEN 'message.read'
         WHEN 'booking.events.v1.chat.message_sent.create' THEN 'chat.message_sent' END AS chat_action,
    CASE event_type WHEN 'jitsi.events.v1.audioMuteStatusChanged.create' THEN 'audioMuteStatusChanged'
         WHEN 'jitsi.events.v1.deviceListChanged.create' THEN 'deviceListChanged' ELSE event_type END AS video_action
  FROM log WHERE booking_id IS NOT NULL),
fx AS (SELECT *, CASE user_role WHEN 'organizer' THEN organizer WHEN 'client' THEN client END AS own FROM f0),
mentions AS (
  SELECT event_id, received_at, organizer AS email, 'organizer' AS role, CASE WHEN k % 2 = 0 THEN 'UTC' END AS time_zone, 0 AS pos
  FROM fx WHERE organizer IS NOT NULL
  UNION ALL
  SELECT event_id, received_at, client, 'client', 'zone' || (k % 3), CASE WHEN organizer IS NULL THEN 0 ELSE 1 END
  FROM fx WHERE client IS NOT NULL),
seen AS (SELECT email, min(row(received_at, event_id)) AS first_seq FROM mentions GROUP BY email),
bk AS (
  SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY received_at, event_id) AS rn FROM fx),
bk_table AS (
  SELECT booking_id, arg_min(occurred_at, row(received_at, event_id)) AS first_seen_at,
    max(occurred_at) AS last_seen_at,
    arg_max(start_time, row(received_at, event_id)) AS start_time,
    arg_max(end_time, row(received_at, event_id)) AS end_time,
    arg_max(booking_status, row(received_at, event_id)) AS current_status,
    arg_max(organizer, row(received_at, event_id)) AS organizer,
    arg_max(client, row(received_at, event_id)) AS client,
    arg_min(event_id, row(received_at, event_id)) AS first_event_id
  FROM bk WHERE queue = 'events.booking.lifecycle' OR rn = 1 GROUP BY booking_id),
links AS (
  SELECT booking_id, coalesce(organizer, client) AS participant, 'https://meet.x.org/' || k AS meeting_url,
         event_id AS source_event_id, occurred_at
  FROM fx WHERE event_type = '{MEETING}' AND coalesce(organizer, client) IS NOT NULL AND k % 11 <> 0
  QUALIFY row_number() OVER (PARTITION BY booking_id, coalesce(organizer, client) ORDER BY received_at DESC, event_id DESC) = 1),
tg0 AS (
  SELECT f.*, coalesce(CASE WHEN f.user_role = 'organizer' THEN f.organizer ELSE f.client END, s.email) AS participant
  FROM fx f LEFT JOIN seen s ON s.email = f.actor AND s.first_seq <= row(f.received_at, f.event_id)
  WHERE f.event_type = '{TELEGRAM}'),
telegrams AS (
  SELECT booking_id, participant, trig AS trigger_event, event_id AS sent_event_id, occurred_at AS sent_at FROM tg0
  QUALIFY row_number() OVER (PARTITION BY booking_id, participant, trig,
    CASE WHEN participant IS NULL OR trig IS NULL THEN event_id END ORDER BY received_at DESC, event_id DESC) = 1),
video AS (
  SELECT event_id AS raw_event_id, booking_id, video_action AS video_event_type, video_role AS participant_role,
    CASE video_role WHEN 'organizer' THEN organizer WHEN 'client' THEN client END AS participant, received_at AS event_time
  FROM fx WHERE event_type LIKE 'jitsi.events.v1.%')"""

LOG = f"WITH {EV}, {DEDUP}"
FACTS = f"{LOG}, {FX}"


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


# --- sources and sinks ---------------------------------------------------------------

_DECODED = f"""WITH {EV}, d AS (
  SELECT *, n % 50 AS damage,
    CASE WHEN n % 50 = 6 THEN '{{not json' WHEN n % 50 = 7 THEN '' WHEN n % 50 = 8 THEN '[1]' ELSE props END AS body FROM ev),
r AS (SELECT *, CASE damage WHEN 1 THEN 'missing_id' WHEN 2 THEN 'missing_type' WHEN 3 THEN 'missing_source' WHEN 4 THEN 'bad_time'
  WHEN 6 THEN 'bad_json' WHEN 8 THEN CASE WHEN booking_id IS NOT NULL THEN 'payload_not_object' END END AS reject_reason FROM d)"""

sql("decode_messages", f"""{_DECODED}
SELECT event_id, booking_id, event_type, source, CASE WHEN damage = 5 THEN received_at ELSE occurred_at END AS occurred_at,
  received_at, queue, CASE WHEN damage = 7 THEN '{{}}' ELSE body END AS payload_json,
  md5(CASE WHEN damage = 7 THEN '{{}}' ELSE body END) AS payload_hash, idempotency_key, trace_id, NULL::VARCHAR AS span_id
FROM r WHERE reject_reason IS NULL""")
sql("rejected_messages", f"""{_DECODED}
SELECT reject_reason, queue, CASE WHEN damage <> 1 THEN event_id END AS event_id, CASE WHEN damage <> 2 THEN event_type END AS event_type,
  CASE WHEN damage <> 3 THEN source END AS source,
  CASE WHEN damage = 4 THEN 'soon' ELSE strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') END AS raw_time, body
FROM r WHERE reject_reason IS NOT NULL""")
sql("reject_metrics", f"""{_DECODED}
SELECT queue, count(*) AS received, count(reject_reason) AS rejected, count(reject_reason) / count(*) AS error_rate FROM r GROUP BY queue""")
sql("queue_messages", f"WITH {EV} SELECT queue, count(*) AS messages FROM ev WHERE queue IN ('events.chat', 'events.mail') GROUP BY queue")
sql("publish_messages", f"""WITH {EV}
SELECT queue AS routing_key, event_id AS ce_id, event_type AS ce_type, source AS ce_source,
  strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ce_time, booking_id AS ce_booking_id,
  6 + CASE WHEN booking_id IS NULL THEN 0 ELSE 1 END + CASE WHEN idempotency_key IS NULL THEN 0 ELSE 1 END AS header_count,
  props AS body, 'application/json' AS content_type, event_type AS message_type FROM ev""")

# --- routing and classification ------------------------------------------------------

sql("route_events", f"WITH {EV} SELECT event_id, queue AS routing_key FROM ev")
sql("route_by_globs", f"""WITH {EV} SELECT event_id, CASE
  WHEN source LIKE 'get_tream' AND event_type LIKE '%.message.new.%' THEN 'chat-new'
  WHEN source = 'jitsi-eu' AND event_type LIKE 'jitsi.events.v1.%' AND substr(event_type, 17, 1) <> 'd' THEN 'video'
  WHEN source LIKE 'jitsi%' AND event_type ILIKE '%device%' THEN 'devices'
  WHEN event_type = 'billing.v1.charge.create' THEN 'dotless'
  WHEN source NOT LIKE 'b%' AND event_type LIKE '%.create' THEN 'odd'
  ELSE 'rest' END AS routing_key FROM ev""")
sql("route_by_rule_table", f"""WITH {EV} SELECT event_id, CASE
  WHEN source LIKE 'get_tream' AND event_type LIKE '%.message.new.%' THEN 'chat-new'
  WHEN source = 'jitsi-eu' AND event_type LIKE 'jitsi.events.v1.%' AND substr(event_type, 17, 1) <> 'd' THEN 'video'
  WHEN source LIKE 'jitsi%' AND event_type ILIKE '%device%' THEN 'devices'
  WHEN event_type = 'billing.v1.charge.create' THEN 'dotless'
  WHEN source NOT LIKE 'b%' AND event_type LIKE '%.create' THEN 'odd'
  ELSE 'of:' || event_type END AS routing_key FROM ev""")
sql("route_counts", f"WITH {EV} SELECT queue AS routing_key, count(*) AS events FROM ev GROUP BY queue")
sql("destination_counts", f"""WITH {EV} SELECT d.destination, count(ev.queue) AS events FROM (VALUES ('events.booking.lifecycle'),
  ('events.booking.reminder'), ('events.chat.lifecycle'), ('events.chat.activity'), ('events.meeting.lifecycle'),
  ('events.notification.delivery'), ('events.jitsi'), ('events.mail'), ('events.chat'), ('events.unrouted')) d(destination)
  LEFT JOIN ev ON ev.queue = d.destination GROUP BY d.destination""")
sql("classify_events", f"""WITH {EV}, c AS (SELECT *, CASE WHEN event_type = '{NEW}' THEN 'message.new' END AS ptype FROM ev)
SELECT event_id, CASE
  WHEN source = 'getstream' AND ptype IS NOT NULL THEN ptype
  WHEN event_type = 'jitsi.events.v1.create' THEN event_type
  WHEN event_type LIKE '%.v1.%' AND event_type LIKE '%.create' THEN regexp_extract(event_type, '\\.v1\\.(.*)\\.create$', 1)
  ELSE event_type END AS action FROM c""")
sql("domain_counts", f"""WITH {EV} SELECT CASE split_part(queue, '.', 2) WHEN 'booking' THEN 'booking' WHEN 'chat' THEN 'chat'
  WHEN 'meeting' THEN 'meeting' WHEN 'notification' THEN 'notification' WHEN 'mail' THEN 'notification' WHEN 'jitsi' THEN 'video' END AS domain,
  count(*) AS events FROM ev GROUP BY 1""")

# --- deduplication -------------------------------------------------------------------

sql("dedup_content", f"""WITH {EV} SELECT event_id, booking_id, event_type, source, received_at, payload_hash FROM ev
QUALIFY booking_id IS NULL OR row_number() OVER (PARTITION BY booking_id, event_type, source, payload_hash ORDER BY received_at, event_id) = 1""")
sql("dedup_idempotency", f"""WITH {EV} SELECT event_id, booking_id, event_type, source, idempotency_key, received_at FROM ev
QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY received_at, event_id) = 1""")
sql("dedup_history", f"""WITH {EV} SELECT event_id, booking_id, event_type, source, payload_hash, received_at FROM ev
QUALIFY row_number() OVER (PARTITION BY booking_id, event_type, source, payload_hash ORDER BY received_at, event_id) = 1""")
sql("dedup_both", f"{LOG} SELECT event_id, booking_id, event_type, source, idempotency_key, payload_hash, received_at FROM log")
sql("dedup_unkeyed_scope", f"""WITH {EV} SELECT event_id, booking_id, event_type, source, idempotency_key, received_at FROM ev
QUALIFY CASE WHEN idempotency_key IS NOT NULL THEN row_number() OVER (PARTITION BY idempotency_key ORDER BY received_at, event_id) = 1
  ELSE booking_id IS NULL OR row_number() OVER (PARTITION BY idempotency_key IS NULL, booking_id, event_type, source, payload_hash
    ORDER BY received_at, event_id) = 1 END""")
sql("dedup_incremental", f"{LOG} SELECT event_id, booking_id, event_type, source, idempotency_key, received_at FROM log WHERE received_at >= TIMESTAMP '2024-01-16'")
_REUSED = f"WITH {EV}, r AS (SELECT *, strftime(received_at, '%Y%m%d%H') || '-' || (user_id % 100) AS id FROM ev), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, event_id) AS rn FROM r)"
sql("id_conflicts", f"{_REUSED} SELECT id AS event_id, received_at, event_type, 'event_id_conflict' AS reject_reason FROM ranked WHERE rn > 1")
sql("id_first", f"{_REUSED} SELECT id AS event_id, received_at, event_type FROM ranked WHERE rn = 1")
sql("insert_once", f"""{FACTS} SELECT v.raw_event_id, v.booking_id, v.video_event_type FROM video v JOIN fx ON fx.event_id = v.raw_event_id
WHERE fx.received_at >= TIMESTAMP '2024-01-20'""")

# --- extraction ----------------------------------------------------------------------

sql("payload_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number,
  CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS k_text, NULL::VARCHAR AS absent,
  json_type(props) = 'OBJECT' AS is_object, json_extract_string(props, '$.k') <> '0' AS k_truthy FROM events""")
sql("event_participants", f"{FACTS} SELECT event_id, pos, email, role, time_zone FROM mentions")
sql("event_bookings", f"{FACTS} SELECT event_id, booking_id, organizer, client, start_time, end_time, booking_status FROM fx")
sql("chat_fields", f"""{FACTS} SELECT event_id, chat_action, CASE WHEN event_type = '{NEW}' THEN 'm' || (k % 30) END AS message_id,
  actor AS acting_email, user_role AS first_user_role, CASE WHEN event_type = '{NEW}' THEN md5(left(repeat('né', k * 6), 512)) END AS preview_hash
FROM fx WHERE is_chat""")
sql("custom_classifier", f"{FACTS} SELECT event_id, source || '/' || event_type AS chat_action FROM fx WHERE is_chat")
sql("read_fields", f"{FACTS} SELECT event_id, actor AS acting_email, 'm' || (k % 30 - 1) AS last_read_message_id FROM fx WHERE event_type = '{READ}'")
sql("notification_fields", f"""{FACTS} SELECT event_id, CASE WHEN event_type <> '{TELEGRAM}' THEN job END AS job_id,
  CASE WHEN event_type <> '{STATUS}' THEN trig END AS trigger_event, actor AS recipient_email,
  CASE WHEN event_type = '{STATUS}' THEN 's' || (k % 5) END AS status,
  CASE WHEN event_type = '{STATUS}' AND k % 6 = 0 THEN 'https://c.x.org/' || k END AS clicked_url,
  CASE WHEN event_type = '{STATUS}' THEN occurred_at END AS status_time
FROM fx WHERE event_type IN ('{EMAIL}', '{TELEGRAM}', '{STATUS}')""")
sql("video_fields", f"""{FACTS} SELECT event_id, video_action, video_role, received_at AS video_time,
  CASE video_action WHEN 'audioMuteStatusChanged' THEN CASE WHEN k % 2 = 0 THEN '{{"muted":true}}' ELSE '{{}}' END
    WHEN 'deviceListChanged' THEN CASE WHEN k % 2 = 1 THEN '{{"devices":{{"count":' || k || '}}}}' ELSE '{{}}' END END AS kept
FROM fx WHERE event_type LIKE 'jitsi.events.v1.%'""")
sql("projection_rejects", f"""{FACTS} SELECT event_id, 'meeting_links' AS projection, 'meeting_url_not_text' AS reject_reason
FROM fx WHERE event_type = '{MEETING}' AND coalesce(organizer, client) IS NOT NULL AND k % 11 = 0""")

# --- entities from orders ------------------------------------------------------------


def _orders(late: bool) -> str:
    received = "o_orderdate + CAST(o_orderkey % 30 AS INT) * INTERVAL 1 DAY" if late else "o_orderdate"
    return f"""
ol AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS event_id, 'b' || o_custkey AS booking_id, o_orderdate AS occurred_at,
  {received} AS received_at,
  CASE o_orderstatus WHEN 'O' THEN '{CREATED}' WHEN 'F' THEN '{REASSIGNED}' ELSE '{CANCELLED}' END AS event_type,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3') THEN 'events.booking.lifecycle' ELSE 'events.unrouted' END AS queue,
  CASE WHEN left(o_orderpriority, 1) <> '3' THEN 'org' || left(o_orderpriority, 1) END AS organizer,
  CASE WHEN o_orderstatus = 'O' THEN c_name END AS client, c_name,
  CASE o_orderstatus WHEN 'O' THEN 'client' WHEN 'F' THEN 'guest' END AS c_role,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN lower(o_orderpriority) END AS c_zone,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status
  FROM orders JOIN customer ON c_custkey = o_custkey),
om AS (
  SELECT organizer AS email, 'organizer' AS role, NULL::VARCHAR AS time_zone, received_at, event_id, 0 AS pos FROM ol WHERE organizer IS NOT NULL
  UNION ALL SELECT c_name, c_role, c_zone, received_at, event_id, 1 FROM ol),
ob AS (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY received_at, event_id) AS rn FROM ol),
gated AS (SELECT * FROM ob WHERE queue = 'events.booking.lifecycle' OR rn = 1),
ot AS (
  SELECT booking_id, arg_min(occurred_at, row(received_at, event_id)) AS first_seen_at, max(occurred_at) AS last_seen_at,
    arg_max(occurred_at, row(received_at, event_id)) AS start_time, NULL::TIMESTAMP AS end_time,
    arg_max(status, row(received_at, event_id)) AS current_status, arg_max(organizer, row(received_at, event_id)) AS organizer,
    arg_max(client, row(received_at, event_id)) AS client, arg_min(event_id, row(received_at, event_id)) AS first_event_id
  FROM gated GROUP BY booking_id),
cand AS (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY received_at, event_id) AS i
  FROM gated WHERE event_type IN ('{CREATED}', '{REASSIGNED}') AND organizer IS NOT NULL)"""


def _people(name: str, where: str) -> str:
    return f"""{name} AS (SELECT email, arg_max(role, row(received_at, event_id, pos)) AS role, arg_max(time_zone, row(received_at, event_id, pos)) AS time_zone,
  arg_min(event_id, row(received_at, event_id, pos)) AS first_event_id FROM om WHERE {where} GROUP BY email)"""


ORDERS, ORDERS_LATE = f"WITH RECURSIVE {_orders(False)}", f"WITH RECURSIVE {_orders(True)}"
HALVES = f"{ORDERS}, {_people('old', 'received_at < TIMESTAMP ' + repr('1998-01-01'))}, {_people('new', 'received_at >= TIMESTAMP ' + repr('1998-01-01'))}"
# in arrival order times never fall, so a change is a difference to the row before
HISTORY = """hist AS (SELECT booking_id, organizer, event_id AS source_event_id, occurred_at AS effective_from, received_at FROM (
  SELECT *, lag(organizer) OVER (PARTITION BY booking_id ORDER BY i) AS before FROM cand) WHERE before IS DISTINCT FROM organizer)"""
# with late rows the newest entry is carried along row by row
LATE = """walk AS (
  SELECT booking_id, i, organizer, event_id, occurred_at, received_at, true AS kept, organizer AS top, occurred_at AS top_at FROM cand WHERE i = 1
  UNION ALL
  SELECT c.booking_id, c.i, c.organizer, c.event_id, c.occurred_at, c.received_at, c.organizer <> w.top,
    CASE WHEN c.organizer <> w.top AND c.occurred_at >= w.top_at THEN c.organizer ELSE w.top END,
    CASE WHEN c.organizer <> w.top AND c.occurred_at >= w.top_at THEN c.occurred_at ELSE w.top_at END
  FROM walk w JOIN cand c ON c.booking_id = w.booking_id AND c.i = w.i + 1),
hist AS (SELECT booking_id, organizer, event_id AS source_event_id, occurred_at AS effective_from, received_at FROM walk WHERE kept)"""
PERIODS = "periods AS (SELECT *, lead(effective_from) OVER (PARTITION BY booking_id ORDER BY effective_from, received_at, source_event_id) AS effective_to FROM hist)"
_BOOKING = "booking_id, first_seen_at, last_seen_at, start_time, end_time, current_status, organizer, client, first_event_id"

sql("participants_upsert", f"{ORDERS}, {_people('p', 'true')} SELECT * FROM p")
sql("participants_changed", f"""{HALVES} SELECT email, role, time_zone FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.email = n.email
  AND (n.role IS NULL OR n.role = o.role) AND (n.time_zone IS NULL OR n.time_zone = o.time_zone))""")
sql("participants_merge", f"""{HALVES} SELECT coalesce(o.email, n.email) AS email, coalesce(n.role, o.role) AS role,
  coalesce(n.time_zone, o.time_zone) AS time_zone FROM old o FULL JOIN new n ON n.email = o.email""")
sql("bookings_upsert", f"{ORDERS_LATE} SELECT {_BOOKING} FROM ot")
sql("organizer_history", f"{ORDERS}, {HISTORY} SELECT * EXCLUDE received_at FROM hist")
sql("organizer_history_late", f"{ORDERS_LATE}, {LATE} SELECT * EXCLUDE received_at FROM hist")
sql("latest_organizer", f"""{ORDERS_LATE}, {LATE} SELECT booking_id, organizer, effective_from FROM hist
QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY effective_from DESC, received_at DESC, source_event_id DESC) = 1""")
sql("organizer_periods", f"{ORDERS}, {HISTORY}, {PERIODS} SELECT * EXCLUDE received_at FROM periods")

# --- projections from events ---------------------------------------------------------

_CHAT = f"""chat AS (
  SELECT f.event_id AS raw_event_id, f.booking_id, f.source AS provider, f.chat_action AS chat_event_type,
    CASE WHEN f.event_type = '{NEW}' THEN 'm' || (f.k % 30) END AS message_id, coalesce(f.own, s.email) AS participant,
    f.occurred_at, f.received_at
  FROM fx f LEFT JOIN seen s ON s.email = f.actor AND s.first_seq <= row(f.received_at, f.event_id) WHERE f.is_chat),
reads AS (
  SELECT f.booking_id, f.event_id, f.received_at, f.occurred_at, 'm' || (f.k % 30 - 1) AS last_read, s.email AS reader
  FROM fx f JOIN seen s ON s.email = f.actor AND s.first_seq <= row(f.received_at, f.event_id) WHERE f.event_type = '{READ}')"""

sql("meeting_links", f"{FACTS} SELECT * FROM links")
sql("telegram_notifications", f"{FACTS} SELECT * FROM telegrams")
sql("video_events", f"{FACTS} SELECT * FROM video")
sql("event_chat", f"""{FACTS}, {_CHAT} SELECT c.* EXCLUDE received_at, CASE WHEN c.chat_event_type = 'message.new' AND EXISTS (
  SELECT 1 FROM reads r WHERE r.booking_id = c.booking_id AND r.reader <> c.participant
    AND (r.received_at, r.event_id) >= (c.received_at, c.raw_event_id)
    AND (r.last_read = c.message_id OR c.occurred_at < r.occurred_at)) THEN true END AS is_read FROM chat c""")
sql("event_bookings_table", f"{FACTS} SELECT {_BOOKING} FROM bk_table")
sql("custom_projection", f"""{FACTS} SELECT booking_id, count(*) AS times, any_value(b.current_status) AS current_status FROM log JOIN bk_table b USING (booking_id)
WHERE event_type = 'booking.rescheduled' GROUP BY booking_id""")

# --- projections from orders, lineitem and conversations -----------------------------

MAIL = """WITH sent AS (
  SELECT 'o' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS event_id, 'b' || o_custkey AS booking_id, o_orderdate AS t_at,
    CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderpriority < '5' THEN o_orderpriority END AS trig,
    CASE WHEN o_orderstatus = 'F' THEN 'cust' || o_custkey END AS own,
    CASE WHEN o_orderstatus = 'O' THEN 'cust' || o_custkey END AS email, 'cust' || o_custkey AS mentioned FROM orders),
st AS (
  SELECT concat_ws('-', 's', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_linenumber, l_partkey, l_suppkey) AS event_id, 'b' || l_suppkey AS booking_id,
    l_shipdate AS t_at, CAST(l_orderkey AS VARCHAR) AS job_id, 'cust' || l_partkey AS email, l_linestatus || l_linenumber AS status,
    CASE WHEN l_returnflag = 'R' THEN 'https://x.org/' || l_partkey END AS url, CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS status_time FROM lineitem),
seen AS (SELECT mentioned AS email, min(row(t_at, event_id)) AS first_seq FROM sent GROUP BY 1),
allm AS (
  SELECT s.job_id, s.booking_id, s.t_at, s.event_id, coalesce(s.own, p.email) AS participant FROM sent s
    LEFT JOIN seen p ON p.email = s.email AND p.first_seq <= row(s.t_at, s.event_id)
  UNION ALL
  SELECT s.job_id, s.booking_id, s.t_at, s.event_id, p.email FROM st s LEFT JOIN seen p ON p.email = s.email AND p.first_seq <= row(s.t_at, s.event_id)),
a AS (SELECT job_id, arg_max(booking_id, row(t_at, event_id)) AS booking_id, arg_max(participant, row(t_at, event_id)) AS participant FROM allm GROUP BY job_id),
b AS (SELECT job_id, trig AS trigger_event, event_id AS sent_event_id, t_at AS sent_at FROM sent
      QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY t_at DESC, event_id DESC) = 1),
c AS (SELECT job_id, status AS last_status, status_time AS last_status_event_time, event_id AS last_status_event_id FROM st
      QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY t_at DESC, event_id DESC) = 1),
u AS (SELECT job_id, arg_max(url, row(t_at, event_id)) AS last_clicked_url FROM st GROUP BY job_id),
mails AS (SELECT a.*, b.* EXCLUDE job_id, c.* EXCLUDE job_id, u.last_clicked_url FROM a LEFT JOIN b USING (job_id) LEFT JOIN c USING (job_id) LEFT JOIN u USING (job_id)),
hist AS (SELECT job_id, status, status_time AS status_event_time, event_id AS source_event_id FROM st
      QUALIFY row_number() OVER (PARTITION BY job_id, status ORDER BY t_at DESC, event_id DESC) = 1)"""

sql("email_notifications", f"{MAIL} SELECT * FROM mails")
sql("email_notifications_by_time", f"""{MAIL}, ct AS (SELECT job_id, status AS last_status, status_time AS last_status_event_time, event_id AS last_status_event_id
  FROM st QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY status_time DESC NULLS LAST, t_at DESC, event_id DESC) = 1)
SELECT a.job_id, ct.* EXCLUDE job_id FROM a LEFT JOIN ct USING (job_id)""")
sql("email_status_history", f"{MAIL} SELECT * FROM hist")
sql("email_status_events", f"{MAIL} SELECT job_id, status, status_time AS status_event_time, event_id AS source_event_id FROM st")

CONV = """WITH cv AS (
  SELECT lpad(CAST(conv_id AS VARCHAR), 9, '0') || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS raw_event_id, 'b' || conv_id AS booking_id, 'getstream' AS provider,
    CASE WHEN turn % 3 = 2 THEN 'message.read' ELSE 'message.new' END AS chat_event_type,
    CASE WHEN turn % 3 <> 2 THEN 'm' || turn END AS message_id, role || '@x.org' AS participant,
    CASE WHEN turn % 3 <> 2 THEN left(text, 512) END AS text_preview, TIMESTAMP '2026-01-01' + CAST(turn AS INT) * INTERVAL 1 MINUTE AS occurred_at, turn
  FROM conversations),
cr AS (SELECT m.* EXCLUDE turn, CASE WHEN chat_event_type = 'message.new' AND EXISTS (SELECT 1 FROM cv r WHERE r.booking_id = m.booking_id
  AND r.chat_event_type = 'message.read' AND r.participant <> m.participant AND r.turn > m.turn) THEN true END AS is_read FROM cv m)"""
sql("chat_events", f"{CONV} SELECT * EXCLUDE turn FROM cv")
sql("chat_read_state", f"{CONV} SELECT raw_event_id, booking_id, participant, is_read FROM cr")

# --- read operators ------------------------------------------------------------------

sql("timeline_topk", f"""WITH {EV} SELECT booking_id, row_number() OVER (PARTITION BY booking_id ORDER BY occurred_at DESC, event_id DESC) AS rank, event_id, occurred_at
FROM ev WHERE booking_id IS NOT NULL QUALIFY rank <= 3""")
sql("booking_timeline", f"WITH {EV} SELECT event_id, event_type, occurred_at FROM ev WHERE booking_id = 'b7'")
sql("events_by_type", f"WITH {EV} SELECT event_id, booking_id, occurred_at FROM ev WHERE event_type = '{CREATED}' ORDER BY occurred_at DESC, event_id DESC LIMIT 100")
sql("recent_bookings", f"{ORDERS} SELECT booking_id, last_seen_at, current_status FROM ot ORDER BY last_seen_at DESC, booking_id DESC LIMIT 20")
sql("history_of_booking", f"{ORDERS}, {HISTORY}, {PERIODS} SELECT * EXCLUDE received_at FROM periods WHERE booking_id = 'b5'")
sql("links_of_bookings", f"""{FACTS} SELECT l.booking_id, l.participant, l.meeting_url, l.source_event_id, b.first_seen_at, b.last_seen_at, b.current_status
FROM links l LEFT JOIN bk_table b USING (booking_id)""")
sql("emails_of_booking", f"{MAIL} SELECT job_id, sent_at, last_status FROM mails WHERE booking_id = 'b5'")
sql("emails_by_status_time", f"{MAIL} SELECT job_id, last_status_event_time FROM mails WHERE last_status = 'O1'")
sql("telegrams_of_booking", f"{FACTS} SELECT sent_event_id, participant, sent_at FROM telegrams WHERE booking_id = 'b7'")
sql("emails_with_history", f"{MAIL} SELECT h.job_id, m.booking_id, h.status, h.status_event_time, h.source_event_id FROM hist h JOIN mails m USING (job_id)")
sql("chat_of_booking", f"{CONV} SELECT raw_event_id, participant, is_read, occurred_at FROM cr WHERE booking_id = 'b3' AND chat_event_type = 'message.new'")
sql("video_of_booking", f"{FACTS} SELECT raw_event_id, event_time FROM video WHERE booking_id = 'b7' AND video_event_type = 'audioMuteStatusChanged'")
sql("role_counts", f"{ORDERS}, {_people('p', 'true')} SELECT role, count(*) AS participants FROM p GROUP BY role")
sql("organizers", f"{ORDERS}, {_people('p', 'true')} SELECT email, time_zone FROM p WHERE role = 'client'")
sql("trace_lookup", f"WITH {EV} SELECT event_id, event_type, occurred_at FROM ev WHERE trace_id = 't42'")
sql("latest_event_per_booking", f"""WITH {EV} SELECT booking_id, event_id, event_type, occurred_at FROM ev WHERE booking_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY occurred_at DESC, event_id DESC) = 1""")

# --- checks and metrics --------------------------------------------------------------


def _orphans(child: str, column: str, parent: str, parent_column: str) -> str:
    return f"""SELECT '{child}' AS child, '{column}' AS "column", '{parent}' AS parent, CAST({column} AS VARCHAR) AS missing, count(*) AS rows
FROM {child} c WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_column} = c.{column}) GROUP BY {column}"""


sql("orphans", " UNION ALL ".join([
    _orphans("orders", "o_custkey", "customer", "c_custkey"),
    _orphans("lineitem", "l_orderkey", "orders", "o_orderkey"),
    _orphans("lineitem", "l_partkey", "supplier", "s_suppkey"),
    _orphans("labels", "doc_id", "documents", "doc_id"),
    _orphans("documents", "doc_id", "labels", "doc_id"),
    _orphans("events", "user_id", "supplier", "s_suppkey"),
]))
sql("event_metrics", f"""WITH {EV} SELECT queue, event_type, count(*) AS events, count(booking_id) AS with_booking, min(occurred_at) AS first_at,
  max(occurred_at) AS last_at FROM ev GROUP BY queue, event_type""")
sql("event_priority", f"""WITH {EV} SELECT CASE WHEN event_type IN ('{CREATED}', '{CANCELLED}') THEN 10 WHEN event_type IN ('{EMAIL}', '{TELEGRAM}') THEN 7
  WHEN event_type = '{STATUS}' THEN 1 ELSE 5 END AS priority, count(*) AS events FROM ev GROUP BY 1""")
sql("contract_violations", f"""WITH {EV} SELECT event_type, field, problem, count(*) AS events FROM (
  SELECT event_type, unnest(['$.user.email', '$.user.time_zone', '$.client.email', '$.client.time_zone', '$.start_time', '$.end_time']) AS field, 'missing' AS problem FROM ev WHERE event_type = '{CREATED}'
  UNION ALL SELECT event_type, unnest(['$.start_time', '$.end_time']), 'missing' FROM ev WHERE event_type = 'booking.rescheduled'
  UNION ALL SELECT event_type, unnest(['$.user.email', '$.user.time_zone']), 'missing' FROM ev WHERE event_type = '{REASSIGNED}'
  UNION ALL SELECT event_type, unnest(['$.organizer_id', '$.client_id']), 'missing' FROM ev WHERE event_type = 'chat.created'
  UNION ALL SELECT event_type, '$.user_id', 'missing' FROM ev WHERE event_type = 'booking.events.v1.chat.message_sent.create'
  UNION ALL SELECT event_type, unnest(['$.email', '$.recipient_role']), 'missing' FROM ev WHERE event_type = '{MEETING}'
  UNION ALL SELECT event_type, '$.meeting_url', 'missing' FROM ev WHERE event_type = '{MEETING}' AND k % 11 = 0
  UNION ALL SELECT event_type, '$.recipient_role', 'missing' FROM ev WHERE event_type IN ('{EMAIL}', '{TELEGRAM}')
  UNION ALL SELECT event_type, '$.trigger_event', 'missing' FROM ev WHERE event_type IN ('{EMAIL}', '{TELEGRAM}') AND k % 4 = 0
) GROUP BY ALL""")
_MAIL, _TELEGRAM, _MOVED = "notification.email.message_sent", TELEGRAM, "booking.rescheduled"
sql("contract_by_rules", f"""WITH {EV}
SELECT event_id, '{_MAIL}' AS event_type, 'usual' AS shape, 'email' AS field, 'missing' AS problem FROM ev WHERE n % 6 = 0 AND k % 5 = 0
UNION ALL SELECT event_id, '{_MAIL}', 'usual', 'recipient_role', 'not_allowed' FROM ev WHERE n % 6 = 0 AND k % 3 = 0
UNION ALL SELECT event_id, '{EMAIL}', 'rejection', 'job_id', 'wrong_type' FROM ev WHERE n % 6 = 1
UNION ALL SELECT event_id, '{EMAIL}', 'rejection', 'available_from', 'wrong_type' FROM ev WHERE n % 6 = 1 AND k % 4 = 0
UNION ALL SELECT event_id, '{EMAIL}', 'rejection', 'has_active_booking', 'missing' FROM ev WHERE n % 6 = 1 AND k % 3 = 0
UNION ALL SELECT event_id, '{EMAIL}', 'rejection', 'previous_meeting_dates', 'wrong_type' FROM ev WHERE n % 6 = 1 AND k % 5 = 0
UNION ALL SELECT event_id, '{CREATED}', 'usual', 'end_time', 'wrong_type' FROM ev WHERE n % 6 = 2
UNION ALL SELECT event_id, '{CREATED}', 'usual', 'user.time_zone', 'missing' FROM ev WHERE n % 6 = 2 AND k % 4 = 0
UNION ALL SELECT event_id, '{CREATED}', 'usual', 'client.email', 'missing' FROM ev WHERE n % 6 = 2 AND k % 5 = 0
UNION ALL SELECT event_id, '{CREATED}', 'usual', 'client.time_zone', 'missing' FROM ev WHERE n % 6 = 2 AND k % 20 IN (0, 4, 5, 8, 10, 12, 15, 16)
UNION ALL SELECT event_id, '{_TELEGRAM}', 'usual', 'recipient_role', 'not_allowed' FROM ev WHERE n % 6 = 3 AND k % 2 = 0
UNION ALL SELECT event_id, '{_MOVED}', 'usual', 'previous_booking.start_time', 'wrong_type' FROM ev WHERE n % 6 = 4 AND k % 3 <> 0
UNION ALL SELECT event_id, 'chat.deleted', 'usual', 'booking_uid', 'missing' FROM ev WHERE n % 6 = 5 AND k % 4 = 0""")
sql("idempotency_keys", f"""WITH {EV} SELECT event_id, sha256(event_type || ':' || CASE WHEN booking_id IS NULL THEN '' ELSE booking_id || ':' END
  || replace(props, ': ', ':')) AS "key" FROM ev""")
sql("replay_window", f"""WITH {EV.replace('FROM e1)', "FROM e1 WHERE received_at >= TIMESTAMP '2024-01-10' AND received_at < TIMESTAMP '2024-01-20')")}, {DEDUP}, {FX}
SELECT {_BOOKING} FROM bk_table""")
sql("normalize_payloads", f"""WITH {EV}, r AS (SELECT *, k % 2 = 0 AS has_client FROM ev WHERE booking_id IS NOT NULL AND source <> 'getstream')
SELECT event_id, 0 AS pos, 'o' || (k % 5) AS email, 'organizer' AS role, 'UTC' AS time_zone FROM r WHERE source = 'booking'
UNION ALL SELECT event_id, 1, 'c' || user_id, 'client', NULL FROM r WHERE source = 'booking' AND has_client
UNION ALL SELECT event_id, 0, 'd' || user_id, NULL, NULL FROM r WHERE event_type = '{STATUS}'""")
sql("normalize_whole", f"""WITH {EV}, r AS (
  SELECT * REPLACE (CASE WHEN event_type = 'booking.rescheduled' AND n % 2 = 0 THEN '{CANCELLED}' ELSE event_type END AS event_type),
    k % 2 = 0 AS has_client, n % 7 = 0 AS has_list FROM ev WHERE booking_id IS NOT NULL),
people AS (
  SELECT event_id, 0 AS pos, 'o' || (k % 5) AS email, 'organizer' AS role, 'UTC' AS time_zone FROM r WHERE source = 'booking' AND NOT has_list
  UNION ALL SELECT event_id, 1, 'c' || user_id, 'client', NULL FROM r WHERE source = 'booking' AND NOT has_list AND has_client
  UNION ALL SELECT event_id, 0, 'u' || user_id, 'client', NULL FROM r WHERE source = 'booking' AND has_list
  UNION ALL SELECT event_id, 0, 'd' || user_id, NULL, NULL FROM r WHERE event_type = '{STATUS}'
  UNION ALL SELECT event_id, 0, 'g' || user_id, NULL, NULL FROM r WHERE source = 'getstream' AND n % 6 < 3)
SELECT event_id, CASE WHEN timed AND n % 4 <> 0 THEN received_at END AS start_time, CASE WHEN timed AND n % 5 <> 0 THEN occurred_at END AS end_time,
  CASE event_type WHEN '{CREATED}' THEN 'created' WHEN '{CANCELLED}' THEN 'cancelled' END AS status, pos, email, role, time_zone
FROM (SELECT *, event_type LIKE 'booking.%' OR event_type LIKE '%.booking.%' AS timed FROM r) LEFT JOIN people USING (event_id)""")

# --- functions -----------------------------------------------------------------------

sql("payload_hashes", """SELECT doc_id, md5(text) AS text_hash, true AS compact_equal,
  md5('{"lang":"' || lang || '","source":"' || source || '"}') AS canonical_hash FROM documents""")
sql("live_hashes", f"""WITH {EV} SELECT event_id, md5(CASE WHEN n % 5 < 3 THEN '{{"k":' || k || ',"url":"https:\\/\\/x.org\\/' || user_id
  || '","name":"\\u00e9 ' || base || '","at":' || CAST(k / 4.0 AS DOUBLE) || '}}' ELSE '{{}}' END) AS payload_hash FROM ev""")
sql("text_previews", "SELECT doc_id, left(text, 512) AS preview FROM documents")
sql("user_id_decode", "SELECT c_custkey, c_name AS opened, true AS wrong_secret_keeps, c_mktsegment AS plain FROM customer")
sql("iso_times", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts)
  WHEN 2 THEN date_trunc('minute', ts) - INTERVAL 3 HOUR WHEN 3 THEN date_trunc('day', ts)::TIMESTAMP WHEN 5 THEN ts END AS "at" FROM events""")

# --- the whole plan ------------------------------------------------------------------

_WALK = f"""cand AS (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY received_at, event_id) AS i FROM bk
  WHERE (queue = 'events.booking.lifecycle' OR rn = 1) AND event_type IN ('{CREATED}', '{REASSIGNED}') AND organizer IS NOT NULL), {LATE}"""
_RECURSIVE_FACTS = FACTS.replace("WITH", "WITH RECURSIVE", 1)
sql("pipeline_counts", f"""{_RECURSIVE_FACTS}, {_WALK}
SELECT 'events' AS table_name, count(*) AS rows FROM log
UNION ALL SELECT 'participants', count(*) FROM seen
UNION ALL SELECT 'bookings', count(*) FROM bk_table
UNION ALL SELECT 'organizer_history', count(*) FROM hist
UNION ALL SELECT 'meeting_links', count(*) FROM links
UNION ALL SELECT 'email_notifications', count(DISTINCT job) FROM fx WHERE event_type IN ('{EMAIL}', '{STATUS}')
UNION ALL SELECT 'telegram_notifications', count(*) FROM telegrams
UNION ALL SELECT 'email_status_history', count(*) FROM (SELECT DISTINCT job, k % 5 FROM fx WHERE event_type = '{STATUS}')
UNION ALL SELECT 'chat_events', count(*) FROM fx WHERE is_chat
UNION ALL SELECT 'video_events', count(*) FROM video""")
sql("stream_log", f"""{_DECODED}, valid AS (
  SELECT event_id, booking_id, event_type, source, CASE WHEN damage = 5 THEN received_at ELSE occurred_at END AS occurred_at, received_at,
    md5(CASE WHEN damage = 7 THEN '{{}}' ELSE body END) AS payload_hash, idempotency_key FROM r WHERE reject_reason IS NULL),
{DEDUP.replace('FROM ev', 'FROM valid')}
SELECT * FROM log""")

# streams end with the tables that the whole log gives at once
ORACLE["stream_bookings"] = ORACLE["bookings_upsert"]
ORACLE["stream_emails"] = ORACLE["email_notifications"]
ORACLE["stream_participant_changes"] = ORACLE["participants_upsert"]
sql("stream_custom", """WITH moved AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS event_id, 'b' || o_custkey AS booking_id, CAST(o_orderdate AS TIMESTAMP) AS made,
    CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS arrived
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F')
SELECT DISTINCT booking_id, first_value(event_id) OVER w AS first_event_id, last_value(event_id) OVER w AS last_event_id, max(made) OVER w AS latest_at
FROM moved WINDOW w AS (PARTITION BY booking_id ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")

_EARLY = "received_at < TIMESTAMP '2024-01-16 00:00:00'"
_PARENTS = {
    ("booking_id", "bookings"): f"SELECT booking_id FROM fx WHERE {_EARLY}",
    ("participant", "participants"): f"SELECT email FROM mentions WHERE {_EARLY}",
    ("raw_event_id", "events"): f"SELECT event_id FROM log WHERE {_EARLY}",
}
sql("pipeline_orphans", f"{FACTS}, {_CHAT} SELECT child, \"column\", parent, missing, count(*) AS rows FROM (" + " UNION ALL ".join(
    f"SELECT '{child}_events' AS child, '{column}' AS \"column\", '{parent}' AS parent, {column} AS missing FROM {child} "
    f"WHERE {column} IS NOT NULL AND {column} NOT IN ({known})"
    for child in ("chat", "video") for (column, parent), known in _PARENTS.items()) + ") GROUP BY ALL")
