"""Test oracle: the event rules applied to one message after the other, in plain Python.

Holds its tables as dictionaries. It is slow and simple on purpose, and shares no code
with the package but its fixed values.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from meetledger import schemas as S


def text(value):
    return value if isinstance(value, str) else None


def at(doc, *path):
    for step in path:
        if isinstance(step, int):
            doc = doc[step] if isinstance(doc, list) and len(doc) > step else None
        else:
            doc = doc.get(step) if isinstance(doc, dict) else None
    return doc


def when(value):
    if not text(value):
        return None
    try:
        moment = datetime.fromisoformat(value)
    except ValueError:
        return None
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


class Refused(Exception):
    pass


class Ledger:
    def __init__(self, decode=lambda x: x):
        self.decode = decode
        self.events, self.rejects = {}, []
        self.keys, self.contents = set(), set()
        self.people, self.bookings, self.history = {}, {}, []
        self.links, self.emails, self.statuses = {}, {}, {}
        self.telegrams, self.chat, self.video = {}, {}, {}
        self.failed = []

    def receive(self, message):
        h = message["headers"]
        e = {
            "id": h.get("ce-id"),
            "type": h.get("ce-type"),
            "source": h.get("ce-source"),
            "booking": h.get("ce-booking_id"),
            "key": h.get("ce-idempotencykey"),
            "queue": message["queue"],
            "received": message["received_at"],
        }
        for part in ("id", "type", "source"):
            if not e[part]:
                return self.rejects.append((f"missing_{part}", e["id"]))
        e["at"] = e["received"] if h.get("ce-time") is None else when(h["ce-time"])
        if e["at"] is None:
            return self.rejects.append(("bad_time", e["id"]))
        body = message["body"]
        try:
            doc = json.loads(body) if body and body.strip() else {}
        except ValueError:
            return self.rejects.append(("bad_json", e["id"]))
        e["text"] = body if doc else "{}"
        e["doc"] = doc or {}
        if e["booking"] and not isinstance(e["doc"], dict):
            return self.rejects.append(("payload_not_object", e["id"]))
        self.store(e)

    def store(self, e):
        content = (e["booking"], e["type"], e["source"], hashlib.md5(e["text"].encode()).hexdigest())
        if e["key"] in self.keys if e["key"] else e["booking"] is not None and content in self.contents:
            return
        if e["id"] in self.events:
            return self.rejects.append(("event_id_conflict", e["id"]))
        if e["key"]:
            self.keys.add(e["key"])
        if e["booking"] is not None:
            self.contents.add(content)
        self.events[e["id"]] = e
        if e["booking"]:
            self.apply(e)

    def apply(self, e):
        organizer = client = None
        for p in at(e["doc"], "normalized", "participants") or [] if isinstance(at(e["doc"], "normalized", "participants"), list) else []:
            email = text(at(p, "email"))
            if not email:
                continue
            role, zone = text(at(p, "role")), text(at(p, "time_zone"))
            known = self.people.setdefault(email, {"role": None, "time_zone": None})
            known["role"] = role if role is not None else known["role"]
            known["time_zone"] = zone if zone is not None else known["time_zone"]
            if role == "organizer":
                organizer = email
            elif role == "client":
                client = email
        e["organizer"], e["client"] = organizer, client
        if e["queue"] == S.QUEUE_LIFECYCLE or e["booking"] not in self.bookings:
            self.book(e)
        for name in ("meeting", "email", "telegram", "status", "chat_event", "chat_read", "video_event"):
            try:
                getattr(self, f"on_{name}")(e)
            except Refused as reason:
                self.failed.append((name, e["id"], str(reason)))

    def book(self, e):
        new = {
            "start_time": when(at(e["doc"], "normalized", "booking", "start_time")),
            "end_time": when(at(e["doc"], "normalized", "booking", "end_time")),
            "current_status": text(at(e["doc"], "normalized", "booking", "status")),
            "organizer": e["organizer"],
            "client": e["client"],
        }
        row = self.bookings.get(e["booking"])
        if row is None:
            self.bookings[e["booking"]] = {"first_seen_at": e["at"], "last_seen_at": e["at"], **new}
        else:
            row["last_seen_at"] = max(row["last_seen_at"], e["at"])
            row.update({k: v for k, v in new.items() if v is not None})
        if e["type"] in (S.BOOKING_CREATED, S.BOOKING_REASSIGNED) and e["organizer"]:
            mine = [(x["from"], i, x["organizer"]) for i, x in enumerate(self.history) if x["booking"] == e["booking"]]
            if not mine or max(mine)[2] != e["organizer"]:
                self.history.append({"booking": e["booking"], "organizer": e["organizer"], "event": e["id"], "from": e["at"]})

    # --- helpers ---

    def person(self, email):
        return email if email in self.people else None

    def first_role(self, doc):
        users = at(doc, "users")
        if isinstance(users, list) and users:
            if not isinstance(users[0], dict):
                raise Refused("first_user_not_object")
            return users[0].get("role")
        return None

    def role_person(self, e, role):
        return {"organizer": e["organizer"], "client": e["client"]}.get(role) if isinstance(role, str) else None

    def recipient(self, doc, role, client_too):
        options = [at(doc, "email")]
        if role == "organizer":
            options += [at(doc, "user", "email"), at(doc, "organizer", "email")]
        if role == "client" and client_too:
            options += [at(doc, "client", "email")]
        return next((o for o in options if text(o)), None)

    def actor(self, e, decode):
        doc = e["doc"]
        if text(at(doc, "users", 0, "email")):
            return at(doc, "users", 0, "email")
        user_id = text(at(doc, "user_id"))
        if user_id and "@" in user_id:
            return user_id
        raw = text(at(doc, "user", "id"))
        if raw:
            raw = self.decode(raw) if decode else raw
            return raw if "@" in raw else None
        return None

    def action(self, e, source):
        def by_type():
            t = e["type"]
            if t.startswith("jitsi.events.v1.") and t.endswith(".create"):
                return t[16:-7]
            if ".v1." in t and t.endswith(".create"):
                return t.partition(".v1.")[2].removesuffix(".create")
            return None

        steps = []
        if e["queue"] == "events.chat":
            steps.append(e["doc"].get("type"))
        if e["queue"] == "events.jitsi" and e["type"].startswith("jitsi."):
            steps.append(by_type())
        if source == "getstream":
            steps.append(e["doc"].get("type"))
        steps.append(by_type())
        found = next((s for s in steps if s), e["type"])
        if not isinstance(found, str):
            raise Refused("type_not_text")
        return found

    # --- projections ---

    def on_meeting(self, e):
        if e["type"] != S.MEETING_URL_CREATED:
            return
        who = e["organizer"] or e["client"]
        if who is None:
            return
        url = e["doc"].get("meeting_url")
        if not isinstance(url, str):
            raise Refused("meeting_url_not_text")
        self.links[(e["booking"], who)] = {"meeting_url": url, "source_event_id": e["id"], "occurred_at": e["at"]}

    def on_email(self, e):
        doc = e["doc"]
        blank = dict.fromkeys(
            "booking_id participant trigger_event sent_event_id sent_at last_status last_status_event_time last_status_event_id last_clicked_url".split()
        )
        if e["type"] == S.EMAIL_SENT:
            job = text(doc.get("job_id"))
            if job is None:
                return
            role = self.first_role(doc)
            who = self.role_person(e, role) or self.person(self.recipient(doc, role, True))
            row = self.emails.setdefault(job, blank)
            row.update(booking_id=e["booking"], trigger_event=text(doc.get("trigger_event")), sent_event_id=e["id"], sent_at=e["at"])
            row["participant"] = who or row["participant"]
        elif e["type"] == S.MAIL_STATUS:
            data = doc.get("event_data")
            email, job = text(at(data, "email")), text(at(data, "job_id"))
            if email is None or job is None:
                return
            row = self.emails.setdefault(job, blank)
            row.update(
                booking_id=e["booking"],
                last_status=text(data.get("status")),
                last_status_event_time=when(data.get("event_time")),
                last_status_event_id=e["id"],
            )
            row["participant"] = self.person(email) or row["participant"]
            url = text(data.get("url"))
            row["last_clicked_url"] = url if url is not None else row["last_clicked_url"]

    def on_telegram(self, e):
        if e["type"] != S.TELEGRAM_SENT:
            return
        role = self.first_role(e["doc"])
        own = e["organizer"] if role == "organizer" else e["client"]
        who = own or self.person(self.recipient(e["doc"], role, False))
        trigger = text(e["doc"].get("trigger_event"))
        key = (e["booking"], who, trigger, e["id"] if who is None or trigger is None else None)
        self.telegrams[key] = {"sent_event_id": e["id"], "sent_at": e["at"]}

    def on_status(self, e):
        if e["type"] != S.MAIL_STATUS:
            return
        data = e["doc"].get("event_data")
        job, status = text(at(data, "job_id")), text(at(data, "status"))
        if job is not None and status is not None:
            self.statuses[(job, status)] = {"status_event_time": when(data.get("event_time")), "source_event_id": e["id"]}

    def on_chat_event(self, e):
        if not (e["source"] == "getstream" or (e["source"] == "booking" and ".chat." in e["type"])):
            return
        doc = e["doc"]
        action = self.action(e, e["source"])
        message_id = text(doc.get("message_id"))
        preview = text(at(doc, "message", "text"))
        role = at(doc, "users", 0, "role")
        self.chat[e["id"]] = {
            "booking_id": e["booking"],
            "provider": e["source"],
            "chat_event_type": action,
            "message_id": message_id if message_id is not None else text(at(doc, "message", "id")),
            "participant": self.role_person(e, role) or self.person(self.actor(e, e["source"] == "getstream")),
            "is_read": None,
            "text_preview": preview[:512] if preview is not None else None,
            "occurred_at": e["at"],
        }

    def on_chat_read(self, e):
        if e["source"] != "getstream" or e["type"] != S.CHAT_MESSAGE_READ:
            return
        last = e["doc"].get("last_read_message_id")
        if last is not None and not isinstance(last, str):
            raise Refused("last_read_not_text")
        reader = self.person(self.actor(e, True))
        for row in self.chat.values():
            if row["booking_id"] != e["booking"] or row["chat_event_type"] != "message.new":
                continue
            if reader is None or row["participant"] is None or row["participant"] == reader:
                continue
            if (last is not None and row["message_id"] == last) or row["occurred_at"] < e["at"]:
                row["is_read"] = True

    def on_video_event(self, e):
        if not e["type"].startswith("jitsi.events.v1."):
            return
        doc = e["doc"]
        action = self.action(e, "jitsi")
        role = text(at(doc, "context", "user", "role"))
        if action in ("audioMuteStatusChanged", "videoMuteStatusChanged"):
            kept = {"muted": doc["muted"]} if isinstance(doc.get("muted"), bool) else {}
        elif action == "deviceListChanged":
            kept = {"devices": doc["devices"]} if isinstance(doc.get("devices"), dict) else {}
        elif action in ("videoConferenceJoined", "videoConferenceLeft"):
            kept = {}
        else:
            kept = doc
        self.video[e["id"]] = {
            "booking_id": e["booking"],
            "video_event_type": action,
            "participant_role": role,
            "participant": self.role_person(e, role),
            "event_time": when(doc.get("time")),
            "payload": kept,
        }
