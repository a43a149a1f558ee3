"""The policy rules as a plain loop over grid steps, and the figures of a run from its decisions."""

import datetime as dt

SCHEMA = ("session_id string, station_id string, arrival_ts timestamp, departure_ts timestamp, "
          "energy_requested_kwh double, energy_delivered_kwh double, max_charge_rate_kw double, "
          "session_duration_minutes int, is_valid boolean")


def session(sid, station, arrival, departure, requested, delivered=None, rate=None, valid=True):
    return (sid, station, arrival, departure, requested, delivered, rate,
            max(0, int((departure - arrival).total_seconds() // 60)), valid)


def literal_loop(rows, policy, minutes, u_of=None):
    """{(session_id, step time): (rate, energy)}: at each step decide for every plugged-in session."""
    rows = [r for r in rows if r[8]]
    h = minutes / 60.0
    start = min(r[2] for r in rows)
    end = max(r[3] for r in rows)
    delivered = {}
    out = {}
    t = start
    while t <= end:
        for (sid, _st, arr, dep, req, dlv, rate, _d, _v) in rows:
            if not (arr <= t < dep):
                continue
            target = req if req is not None else (dlv if dlv is not None else 30.0)
            r = rate if rate is not None else 7.2
            rem = max(0.0, target - delivered.get(sid, 0.0))
            e = c = 0.0
            if policy == "immediate_charge":
                if rem > 0:
                    e = min(rem, r * h)
                    c = e / h
            elif policy == "uniform_spread":
                rem_min = max(0.0, (dep - t).total_seconds() / 60.0)
                if rem > 0 and rem_min > 0:
                    c = min(rem / (rem_min / 60.0), r)
                    e = min(c * h, rem)
            else:
                if rem > 0 and r > 0:
                    slack = max(0.0, (dep - arr).total_seconds() / 3600.0 - target / r)
                    if (t - arr).total_seconds() / 3600.0 >= slack * u_of(sid):
                        e = min(rem, r * h)
                        c = e / h
            delivered[sid] = delivered.get(sid, 0.0) + e
            out[(sid, t)] = (c, e)
        t += dt.timedelta(minutes=minutes)
    return out


def figures(rows, policy, minutes):
    """Grid steps, load by step, peak, average, energy by session and completions of a run."""
    valid = [r for r in rows if r[8]]
    start, end = min(r[2] for r in valid), max(r[3] for r in valid)
    steps = [start + k * dt.timedelta(minutes=minutes) for k in range(int((end - start) / dt.timedelta(minutes=minutes)) + 1)]
    decisions = literal_loop(rows, policy, minutes)
    load = [sum(c for (_s, t), (c, _e) in decisions.items() if t == step) for step in steps]
    energy = {}
    for (sid, _t), (_c, e) in decisions.items():
        energy[sid] = energy.get(sid, 0.0) + e
    targets = {r[0]: r[4] for r in rows if r[4] is not None and r[4] > 0}
    done = sum(energy.get(s, 0.0) >= 0.95 * x for s, x in targets.items() if s in {r[0] for r in valid})
    return {"steps": steps, "load": load, "energy": energy, "peak": max(load), "average": sum(load) / len(steps),
            "active": len({t for _s, t in decisions}), "targets": len(targets), "completed": done}
