"""Classification: the action an event stands for, and the domain of its queue."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from meetledger import schemas as S


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def video_action(event_type: Column) -> Column:
    """What lies between the video prefix and the ``.create`` suffix; NULL when either is absent."""
    start, tail = len(S.VIDEO_TYPE_PREFIX), len(S.CREATE_SUFFIX)
    middle = F.substring(event_type, F.lit(start + 1), F.length(event_type) - F.lit(start + tail))
    return F.when(event_type.startswith(S.VIDEO_TYPE_PREFIX) & event_type.endswith(S.CREATE_SUFFIX), middle)


def type_action(event_type: Column) -> Column:
    """The action named by the event type alone."""
    after_version = F.get(F.split(event_type, r"\.v1\.", 2), F.lit(1))
    general = F.when(event_type.endswith(S.CREATE_SUFFIX), F.regexp_replace(after_version, r"\.create\z", ""))
    is_video = event_type.startswith(S.VIDEO_TYPE_PREFIX) & event_type.endswith(S.CREATE_SUFFIX)
    return F.when(is_video, video_action(event_type)).otherwise(general)


def uses_payload_type(queue: Column, source: Column) -> Column:
    """Whether the payload's own ``type`` decides the action."""
    return F.coalesce(queue == S.QUEUE_CHAT, F.lit(False)) | F.coalesce(source == S.SOURCE_CHAT, F.lit(False))


def action(queue: Column, source: Column, event_type: Column, payload_type: Column) -> Column:
    """Queue rule, then source rule, then event type, then the raw type name."""
    return F.coalesce(
        _filled(F.when(queue == S.QUEUE_CHAT, payload_type).when(queue == S.QUEUE_VIDEO, video_action(event_type))),
        _filled(F.when(source == S.SOURCE_CHAT, payload_type)),
        _filled(type_action(event_type)),
        event_type,
    )


def domain(queue: Column) -> Column:
    """Domain of a queue; NULL for a queue without one."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(S.QUEUE_DOMAINS.items())])
    return F.try_element_at(table, queue)
