"""Literal event-by-event rules, as oracles for the closed forms."""

from __future__ import annotations

BASE = ("DEPLOYING", "LAUNCHING", "UP", "DEPLOY_FAILED")


def fleet(events, timeout, as_of):
    """(steps, final state, dead time) of one instance's events (ts, event_id, kind)."""
    base, deadline, dead, state, steps = None, None, None, None, []
    for ts, event_id, kind in sorted(events):
        if deadline is not None and ts > deadline:
            dead, deadline = deadline, None
            steps.append((dead, None, "DEAD"))
        if dead is not None:
            if base is not None:
                steps.append((ts, event_id, "REJECTED"))
            continue
        if kind in BASE:
            if kind != "LAUNCHING":
                deadline = None
            elif base != "LAUNCHING":
                deadline = ts + timeout
            base = kind
            state = "ABSENT" if kind == "DEPLOY_FAILED" else kind
        elif base is None:
            continue
        elif base == "UP" and state != "ABSENT":
            state = {"UNREACHABLE": "UNREACHABLE", "REACHABLE": "UP", "REMOVED": "ABSENT"}[kind]
        steps.append((ts, event_id, state))
    if deadline is not None and as_of > deadline:
        dead = deadline
        steps.append((dead, None, "DEAD"))
    return steps, ("DEAD" if dead is not None else state), dead


def heartbeat(beats, timeout, limit, as_of, start=None):
    """(beats, missed, terminated, late) of one key, by running its timer."""
    times = sorted(beats)
    clock = start if start is not None else times[0]
    missed_total, seen = 0, 0
    for i, t in enumerate([*times, None]):
        end = as_of if t is None else t
        missed = 0
        while missed < limit and clock + (missed + 1) * timeout <= end:
            if missed + 1 == limit and clock + limit * timeout >= end:
                missed += 1  # counted, but a beat right on the last deadline keeps it alive
                break
            missed += 1
            if missed == limit:
                return seen, missed_total + missed, clock + limit * timeout, len(times) - i
        missed_total += missed
        if t is not None:
            seen += 1
            clock = t
    return seen, missed_total, None, 0


def outage(events, deadline, as_of):
    """Time of the down event that ends the instance, from (ts, event_id, is_down)."""
    events = sorted(events)
    armed = None
    for ts, _, is_down in events:
        if armed is not None and ts - armed > deadline:
            return armed
        armed = ts if is_down else None
    return armed if armed is not None and as_of - armed > deadline else None


def auto_down(events, gone, poll):
    """Episodes (start, end, down) from (ts, event_id, kind); ``gone`` is a time, None (registered) or 'never'."""
    out, open_at = [], None
    events = sorted(events)

    def first_poll(since, end):
        if gone is None:
            return None
        at = since
        while gone != "never" and at < gone:
            at += poll
        return at if end is None or at < end else None

    for ts, _, kind in events:
        if kind == "UNREACHABLE":
            open_at = ts if open_at is None else open_at
        elif open_at is not None:
            out.append((open_at, ts, first_poll(open_at, ts)))
            open_at = None
    if open_at is not None:
        out.append((open_at, None, first_poll(open_at, None)))
    return out


def attempts(events):
    """(attempts, time of success) from (ts, event_id, ok)."""
    n = 0
    for ts, _, ok in sorted(events):
        n += 1
        if ok:
            return n, ts
    return n, None


def senders(asked, answers, timeout, give_up=None):
    """(outcomes, orphans) by walking through time with a map of the open senders, dropped after ``give_up``."""
    log = sorted([(t, 0, "", i) for i, t in asked] + [(t, 1, a, i) for i, a, t in answers])
    open_at, done, orphans = {}, [], []
    for t, is_answer, response, i in log:
        since = open_at.pop(i, None)
        if since is not None and give_up is not None and t > since + give_up:
            done.append((i, since, "TIMED_OUT", None, None))
            since = None
        if not is_answer:
            if since is not None:
                done.append((i, since, "SUPERSEDED", None, None))
            open_at[i] = t
        elif since is None:
            orphans.append((i, response, t, f"Sender with ID {i} was not found"))
        else:
            done.append((i, since, "ANSWERED" if t <= since + timeout else "TIMED_OUT", response, t))
    done += [(i, since, "UNANSWERED" if give_up is None else "TIMED_OUT", None, None) for i, since in open_at.items()]
    return sorted(done, key=str), sorted(orphans, key=str)
