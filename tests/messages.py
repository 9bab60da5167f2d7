"""Random message logs for property tests."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from meetledger import schemas as S

PEOPLE = [f"p{i}@example.org" for i in range(6)]
START = datetime(2026, 3, 1, 8, 0, 0)
TYPES = [
    (S.BOOKING_CREATED, "booking"),
    (S.BOOKING_REASSIGNED, "booking"),
    (S.BOOKING_REASSIGNED, "booking"),
    (S.BOOKING_CANCELLED, "booking"),
    (S.MEETING_URL_CREATED, "booking"),
    (S.EMAIL_SENT, "booking"),
    (S.TELEGRAM_SENT, "booking"),
    (S.MAIL_STATUS, "unisender-go"),
    (S.MAIL_STATUS, "unisender-go"),
    (S.CHAT_MESSAGE_NEW, "getstream"),
    (S.CHAT_MESSAGE_NEW, "getstream"),
    (S.CHAT_MESSAGE_NEW, "getstream"),
    (S.CHAT_MESSAGE_READ, "getstream"),
    (S.CHAT_MESSAGE_READ, "getstream"),
    ("booking.events.v1.chat.message_sent.create", "booking"),
    ("jitsi.events.v1.audioMuteStatusChanged.create", "jitsi-1"),
    ("jitsi.events.v1.deviceListChanged.create", "jitsi-1"),
    ("jitsi.events.v1.videoConferenceJoined.create", "jitsi-1"),
    ("jitsi.events.v1.create", "jitsi-1"),
    ("jitsi.events.v1.knocked.create", "getstream"),
    ("other.thing", "elsewhere"),
]
QUEUES = ["events.booking.lifecycle", "events.booking.lifecycle", "events.chat", "events.jitsi", "events.mail", "events.unrouted"]
STRANGE = [None, "", 5, 0, True, False, [], {}, ["x"], {"email": "p0@example.org"}, 1.5]


def maybe(rng, value, odds=0.1):
    """The value, or now and then something of another kind."""
    return rng.choice(STRANGE) if rng.random() < odds else value


def moment(rng):
    stamp = START + timedelta(minutes=rng.randrange(0, 600))
    forms = [
        stamp.isoformat() + "Z",
        stamp.isoformat() + "+00:00",
        stamp.isoformat(),
        (stamp + timedelta(hours=3)).isoformat() + "+03:00",
        stamp.strftime("%Y%m%dT%H%M%S"),
        stamp.isoformat() + ".123456789Z",
        stamp.strftime("%Y-%m-%d %H:%M"),
        "not a time",
        "2026",
    ]
    return rng.choices(forms, weights=[8, 4, 4, 4, 1, 1, 1, 1, 1])[0]


def user(rng):
    return maybe(rng, {"email": maybe(rng, rng.choice(PEOPLE)), "role": maybe(rng, rng.choice(["organizer", "client", "guest"]))})


def payload(rng, event_type, encode):
    doc = {}
    if rng.random() < 0.6:
        doc["normalized"] = maybe(
            rng,
            {
                "participants": maybe(
                    rng,
                    [
                        maybe(
                            rng,
                            {
                                "email": maybe(rng, rng.choice(PEOPLE)),
                                "role": maybe(rng, rng.choice(["organizer", "client", "organizer", None])),
                                "time_zone": maybe(rng, rng.choice(["UTC", "Europe/Rome", None])),
                            },
                        )
                        for _ in range(rng.randrange(0, 4))
                    ],
                    0.05,
                ),
                "booking": maybe(
                    rng,
                    {
                        "start_time": maybe(rng, moment(rng)),
                        "end_time": maybe(rng, moment(rng)),
                        "status": maybe(rng, rng.choice(["created", "cancelled"])),
                    },
                ),
            },
            0.05,
        )
    fields = {
        "meeting_url": lambda: f"https://meet.example.org/{rng.randrange(3)}",
        "users": lambda: [user(rng) for _ in range(rng.randrange(0, 2))],
        "job_id": lambda: f"job{rng.randrange(6)}",
        "trigger_event": lambda: rng.choice(["BOOKING_CREATED", "BOOKING_CANCELLED"]),
        "email": lambda: rng.choice(PEOPLE),
        "user": lambda: {"email": rng.choice(PEOPLE), "id": rng.choice([encode(rng.choice(PEOPLE)), rng.choice(PEOPLE), "u1"])},
        "client": lambda: {"email": rng.choice(PEOPLE)},
        "organizer": lambda: {"email": rng.choice(PEOPLE)},
        "user_id": lambda: rng.choice([*PEOPLE, "u2"]),
        "message_id": lambda: f"m{rng.randrange(8)}",
        "message": lambda: {"id": maybe(rng, f"m{rng.randrange(8)}"), "text": maybe(rng, "é☃𝄞" * rng.choice([1, 300]))},
        "last_read_message_id": lambda: f"m{rng.randrange(8)}",
        "time": lambda: moment(rng),
        "context": lambda: {"user": maybe(rng, {"role": maybe(rng, rng.choice(["organizer", "client", "x"]))})},
        "muted": lambda: rng.choice([True, False]),
        "devices": lambda: {"mic": [1, "a"], "cam": None},
        "event_data": lambda: {
            "email": maybe(rng, rng.choice(PEOPLE)),
            "job_id": maybe(rng, f"job{rng.randrange(6)}"),
            "status": maybe(rng, rng.choice(["sent", "delivered", "clicked"])),
            "url": maybe(rng, "https://x.example.org"),
            "event_time": maybe(rng, moment(rng)),
        },
    }
    always = {S.MAIL_STATUS: "event_data", S.EMAIL_SENT: "job_id", S.MEETING_URL_CREATED: "meeting_url"}
    for name, make in fields.items():
        if always.get(event_type) == name or rng.random() < 0.4:
            doc[name] = maybe(rng, make(), 0.07)
    if "getstream" in event_type:
        doc["type"] = maybe(rng, event_type.split(".v1.")[1].removesuffix(".create"), 0.05)
    return doc


def random_log(seed, size, bookings=5, encode=lambda x: x, odd=True):
    """Messages in arrival order."""
    rng = random.Random(seed)
    log = []
    for n in range(size):
        received = START + timedelta(seconds=n * 7 + rng.randrange(5), minutes=rng.choice([0, 0, 0, 3000]) if n > size // 2 else 0)
        again = rng.random()
        if log and again < 0.12:
            old = rng.choice(log)
            message = {"headers": dict(old["headers"]), "body": old["body"], "queue": old["queue"]}
            if again < 0.08:
                message["headers"]["ce-id"] = f"e{n:05d}"
            if again < 0.02:
                message["headers"].pop("ce-idempotencykey", None)
            elif again < 0.03:
                message["headers"]["ce-idempotencykey"] = f"k{n}"
        else:
            event_type, source = rng.choice(TYPES)
            headers = {"ce-id": f"e{n:05d}", "ce-type": event_type, "ce-source": source, "ce-specversion": "1.0"}
            if rng.random() < 0.95:
                headers["ce-time"] = (START + timedelta(minutes=rng.randrange(600))).isoformat() + rng.choice(["", "Z", "+00:00"])
            if rng.random() < 0.93:
                headers["ce-booking_id"] = rng.choice([f"b{i}" for i in range(bookings)] + ["b0"] * bookings)
            elif rng.random() < 0.3:
                headers["ce-booking_id"] = ""
            if rng.random() < 0.4:
                headers["ce-idempotencykey"] = rng.choice([f"k{n}", f"k{rng.randrange(size)}", ""])
            body = json.dumps(payload(rng, event_type, encode), ensure_ascii=rng.random() < 0.5)
            message = {"headers": headers, "body": body, "queue": rng.choice(QUEUES)}
            if odd and rng.random() < 0.04:
                kind = rng.randrange(7)
                if kind < 3:
                    headers.pop(["ce-id", "ce-type", "ce-source"][kind])
                elif kind == 3:
                    headers["ce-time"] = "yesterday"
                else:
                    message["body"] = ["", "{broken", "[1, 2]"][kind - 4]
        message["received_at"] = received
        log.append(message)
    log.sort(key=lambda m: (m["received_at"], m["headers"].get("ce-id") or ""))
    return log
