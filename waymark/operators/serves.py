"""The serve state machine of a session as a step function, and its batch fold.

A session's acts, in order, are pulls of the feed, refreshes, requests for more, picks from the browse list, dismissals,
position fixes and its end. Each act that may serve carries the ranked candidates of that moment; what is served, why, in
which group and at which positions is decided by the state alone. The stream form (streaming.state) runs the same step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.geo import metres

#: Size of a menu, and the limits of re-anchoring (fixed values).
FEED_SIZE, MAX_SERVES, MIN_DRIFT_M, MIN_INTERVAL_S, MAX_FIX_AGE_S = 10, 20, 400.0, 120, 900
REASONS = ("initial", "move_reanchor", "manual_refresh", "dismiss_backfill", "browse", "more")
ACTS = ("start", "pull", "refresh", "more", "browse", "dismiss", "fix", "end")
SERVED = ("at", "reason", "serve_group", "position", "place_id")


@dataclass
class Session:
    """What a session's next act depends on. Times are seconds."""

    origin: tuple[float, float] | None = None
    live: bool = True
    group: int = 0
    cards: list[tuple[int, object]] = field(default_factory=list)  # (position, place) of the current group
    anchor: tuple[float, float] | None = None
    opened_at: float | None = None  # of the group's first serve
    last_at: float | None = None  # of its last
    serves: int = 0
    counted: float | None = None  # when the last serve was counted: serves of one second are one
    dry_until: float | None = None
    dismissed: set = field(default_factory=set)
    fix: tuple[float, float, float, float | None] | None = None  # when, where, how exactly


def _alive(s: Session) -> list:
    return [p for _, p in s.cards if p not in s.dismissed]


def _put(s: Session, reason: str, picks: list, at: float, anchor: tuple[float, float] | None, new: bool) -> list[tuple]:
    """Serves the picks, if there are any."""
    if not picks:
        return []
    if new:
        s.group, s.cards, s.anchor, s.opened_at = s.group + 1, [], anchor, at
    s.last_at = at
    if s.counted != at:
        s.serves, s.counted = s.serves + 1, at
    offset = max((p for p, _ in s.cards), default=0)
    own = [(offset + k + 1, place) for k, place in enumerate(picks)]
    s.cards = s.cards + own
    return [(at, reason, s.group, position, place) for position, place in own]


def _fresh(s: Session, ranked: list) -> list:
    return [p for p in ranked if p not in s.dismissed][:FEED_SIZE]


def _more(s: Session, ranked: list, limit: int) -> list:
    there = {p for _, p in s.cards}
    return [p for p in ranked if p not in s.dismissed and p not in there][: max(0, limit)]


def _drifted(s: Session, at: float) -> tuple[float, float] | None:
    """Where the user is, if the feed is to be anchored anew."""
    if s.anchor is None or (s.dry_until is not None and at < s.dry_until) or s.serves >= MAX_SERVES:
        return None
    if s.opened_at is not None and abs(at - s.opened_at) < MIN_INTERVAL_S or s.fix is None or at - s.fix[0] > MAX_FIX_AGE_S:
        return None
    when, lat, lng, exact = s.fix
    least = MIN_DRIFT_M if exact is None else max(MIN_DRIFT_M, exact)
    return (lat, lng) if metres(*s.anchor, lat, lng) >= least else None


def step(s: Session, at: float, act: str, lat: float | None, lng: float | None, accuracy: float | None, place: object, ranked: list) -> list[tuple]:
    """Changes the state by one act; what it serves: (at, reason, serve_group, position, place_id).

    `ranked` are the places that a ranking would give now, best first: for a pull of a moved user from where that user is.
    """
    at = float(int(at))  # serves are stamped to the second
    if act == "start":
        s.origin = (lat, lng) if lat is not None and lng is not None else None
    elif act == "end":
        s.live = False
    elif act == "dismiss":
        s.dismissed.add(place)
    elif act == "fix":
        if lat is not None and lng is not None and (s.fix is None or at >= s.fix[0]):
            s.fix = (at, lat, lng, accuracy)
    elif act == "pull":
        if not s.cards:
            return _put(s, "initial", _fresh(s, ranked), at, s.origin, True) if s.origin is not None else []
        if not s.live:
            return []
        moved = _drifted(s, at)
        if moved is not None:
            recent = s.last_at is not None and abs(at - s.last_at) < MIN_INTERVAL_S  # a top-up counts here
            served = [] if recent else _put(s, "move_reanchor", _fresh(s, ranked), at, moved, True)
            if served:
                return served
            s.dry_until = at + MIN_INTERVAL_S
        alive = len(_alive(s))
        if alive < FEED_SIZE and s.origin is not None:
            return _put(s, "dismiss_backfill", _more(s, ranked, FEED_SIZE - alive), at, s.anchor, False)
    elif act == "refresh":
        here = s.fix[1:3] if s.fix is not None and at - s.fix[0] <= MAX_FIX_AGE_S else s.origin
        if s.live and s.serves < MAX_SERVES and here is not None:
            return _put(s, "manual_refresh", _fresh(s, ranked), at, here, True)
    elif act == "more":
        if s.cards and s.live and s.origin is not None and s.serves < MAX_SERVES:
            return _put(s, "more", _more(s, ranked, FEED_SIZE), at, s.anchor, False)
    elif act == "browse":
        if s.origin is not None and s.live and place in ranked and place not in {p for _, p in s.cards}:
            return _put(s, "browse", [place], at, s.origin, not s.cards)
    return []


def _known(x):
    return None if x is None or x != x else x


def acts_of(pdf: pd.DataFrame) -> Iterator[tuple]:
    """The arguments of step for each row; whole numbers that pandas holds as floats, beside nulls, are whole again."""
    for r in pdf.itertuples(index=False):
        place = _known(r.place_id)
        yield r.at, r.act, _known(r.lat), _known(r.lng), _known(r.accuracy), int(place) if isinstance(place, float) else place, list(r.ranked) if r.ranked is not None else []


def replayed(acts: DataFrame, session: str = "session_id") -> DataFrame:
    """Every card that acts(session, at, seq, act, lat, lng, accuracy, place_id, ranked) serve: (session, seq, at, reason,
    serve_group, position, place_id); at is in seconds, seq orders acts and is unique in a session.

    A session's acts pass through one task in order as a stream; the state is its current menu, what was dismissed and a few
    numbers. Unknown acts change nothing.
    """
    kinds = dict(acts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for own, seq, act in zip(pdf[session], pdf["seq"], acts_of(pdf), strict=True):
                if state is None or own != key:
                    key, state = own, Session()
                out += [(own, seq, *card) for card in step(state, *act)]
            yield pd.DataFrame(out, columns=[session, "seq", *SERVED])

    own = acts.select(session, "at", "seq", "act", "lat", "lng", "accuracy", "place_id", "ranked")
    return own.repartition(session).sortWithinPartitions(session, "seq").mapInPandas(run, f"{session} {kinds[session]}, seq {kinds['seq']}, at double, reason string, serve_group int, position int, place_id {kinds['place_id']}")
