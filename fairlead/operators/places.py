"""Where a vessel is taken to be: one leading place, perhaps a rival, and what reports that fit neither mean.

Nearly all reports follow the one before. Reach between neighbours is worked out for a whole run of reports at once,
and from a settled state (no rival, the leading place is the last report) the machine goes straight to the next report
that breaks the run: out of reach, out of order, after a silence or after the vessel was forgotten. Only there, and
until the state is settled again, reports are taken one by one.

One by one, places that weren't heard of lapse first; then a report gets one of four verdicts by what it can be reached
from, and the verdict says, by the table `Sightings.MOVES`, what becomes of the places.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from typing import NamedTuple

import numpy as np

from fairlead.functions import geo

#: Rows that a run of reports gives rise to: what, where and when, a measure, a distance, and the start of a silence.
SCHEMA = "kind string, mmsi long, t double, lat double, lon double, value double, distance_m double, from_t double"
FOLLOWS, CORROBORATES, RETURNS, STRAYS = "follows", "corroborates", "returns", "strays"


class Place(NamedTuple):
    """A position, when it was last reported, and the last speed known there (NaN: none)."""

    t: float
    lat: float
    lon: float
    sog: float

    def with_report(self, r: Place) -> Place:
        """The place as a report at it leaves it; time never goes back."""
        return Place(max(self.t, r.t), r.lat, r.lon, self.sog if math.isnan(r.sog) else r.sog)

    def metres_to(self, other: Place) -> float:
        return float(metres(self.lat, self.lon, other.lat, other.lon))


def metres(lat1, lon1, lat2, lon2):
    """Great-circle distance, of numbers or arrays."""
    p, q = np.radians(lat1), np.radians(lat2)
    half = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(half)))


def reach_m(p, sog1, sog2, seconds):
    """How far a vessel gets in a time: at the greater of both speeds and a margin, or at the greatest where one is
    unknown. Of numbers or arrays."""
    known = np.minimum(p.max_speed_kn, np.maximum(sog1, sog2) + p.speed_margin_kn)  # NaN where either is
    return np.where(np.isnan(known), p.max_speed_kn, known) * geo.KNOT_MS * np.abs(seconds) + p.slack_m


class Sightings:
    """All that is remembered of one vessel; `feed` takes its next reports."""

    def __init__(self, params) -> None:
        self.p = params
        self._forget()

    def _forget(self) -> None:
        self.lead = self.prior = self.rival = None
        self.rival_since, self.rival_times, self.told = 0.0, 0, False
        self.times: list[float] = []  # the last distinct times, as many as a regular vessel needs
        self.speed = 0.0

    def feed(self, mmsi: int, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, sog: np.ndarray) -> list[tuple]:
        """Rows of SCHEMA that these reports, in order of time but for late ones, give rise to."""
        self.mmsi, self.out, n = mmsi, [], len(t)
        spoken = np.maximum.accumulate(np.where(np.isnan(sog), -1, np.arange(n)))  # the last report with a speed
        known = np.where(spoken >= 0, sog[spoken], self.lead.sog if self.lead else math.nan)
        step = np.diff(t)
        near = metres(lat[:-1], lon[:-1], lat[1:], lon[1:]) <= reach_m(self.p, known[:-1], sog[1:], step)
        plain = near & (step >= 0) & (step < self.p.gap_s)
        breaks, rises = (np.flatnonzero(~plain) + 1).tolist(), (np.flatnonzero(step > 0) + 1).tolist()
        here = lambda i: Place(float(t[i]), float(lat[i]), float(lon[i]), float(sog[i]))
        k, settled = 0, False
        while k < n:
            upto = breaks[at] if (at := bisect_left(breaks, k)) < len(breaks) else n
            if settled and upto > k:
                self._skip(k, upto, t, lat, lon, known, rises)
                if spoken[upto - 1] >= k:
                    self.speed = float(known[upto - 1])
                k = upto
                continue
            verdict = self._take(here(k))
            same_speed = self.lead.sog == known[k] or (math.isnan(self.lead.sog) and math.isnan(known[k]))
            settled = verdict == FOLLOWS and self.rival is None and self.lead.t == t[k] == self.times[-1] and same_speed
            k += 1
        return self.out

    def _skip(self, k: int, upto: int, t, lat, lon, known, rises: list[int]) -> None:
        """Reports k to upto - 1 each follow the one before; k - 1 is the leading place."""
        place = lambda i: Place(float(t[i]), float(lat[i]), float(lon[i]), float(known[i]))
        own = rises[bisect_left(rises, k) : bisect_left(rises, upto)]
        if own:
            self.prior = place(own[-1] - 1)
            self.times = [*self.times, *(float(t[i]) for i in own[-self.p.gap_min_reports :])][-self.p.gap_min_reports :]
        self.lead = place(upto - 1)

    def _tell(self, kind: str, at: Place, value: float = 0.0, distance: float = 0.0, since: float | None = None) -> None:
        self.out.append((kind, self.mmsi, at.t, at.lat, at.lon, float(value), float(distance), since))

    def _take(self, r: Place) -> str:
        p = self.p
        if self.times and math.floor(r.t / p.sweep_s) * p.sweep_s - self.times[-1] > p.forget_s:
            self._tell("expired", r)
            self._forget()
        if self.lead is None:
            self._tell("vessel", r)
            self.lead, verdict = r, FOLLOWS
        else:
            self._silence(r)
            self._lapse(r)
            verdict = self._verdict(r)
            self.MOVES[verdict](self, r)
        if not self.times or r.t >= self.times[-1]:
            self.speed = self.speed if math.isnan(r.sog) else r.sog
            if not self.times or r.t > self.times[-1]:
                self.times = [*self.times, r.t][-p.gap_min_reports :]
        return verdict

    def _silence(self, r: Place) -> None:
        """A silence is judged by when it began, then by the speed before it, then by how regular reports were."""
        p, since = self.p, self.times[-1]
        if r.t - since < p.gap_s:
            return
        if since < p.listening_since:
            self._tell("gap_before_listening", r, r.t - since)
        elif self.speed >= p.gap_min_sog_kn:
            regular = len(self.times) == p.gap_min_reports and since - self.times[0] <= p.gap_s
            self._tell("gap_candidate" if regular else "gap_not_regular", r, r.t - since, self.lead.metres_to(r), since)

    def _lapse(self, r: Place) -> None:
        """Of two places the one that wasn't heard of for long goes, the rival first."""
        if self.rival is None:
            return
        if r.t - self.rival.t > self.p.second_position_s:
            self.rival = None
        elif r.t - self.lead.t > self.p.second_position_s:
            self.lead, self.prior, self.rival = self.rival, None, None
            self._tell("relocated", r)

    def _reaches(self, place: Place | None, r: Place) -> bool:
        return place is not None and place.metres_to(r) <= float(reach_m(self.p, place.sog, r.sog, r.t - place.t))

    def _verdict(self, r: Place) -> str:
        if self._reaches(self.lead, r):
            return FOLLOWS
        if self._reaches(self.rival, r):
            return CORROBORATES
        if self._reaches(self.prior, r) and self.prior.metres_to(r) < self.prior.metres_to(self.lead) / 2:
            return RETURNS
        return STRAYS

    def _jump(self, origin: Place, to: Place) -> None:
        distance = origin.metres_to(to)
        self._tell("position_jump", to, distance / max(abs(to.t - origin.t), 1.0) / geo.KNOT_MS, distance)

    def _follow(self, r: Place) -> None:
        if r.t > self.lead.t:
            self.prior = self.lead
        self.lead = self.lead.with_report(r)

    def _corroborate(self, r: Place) -> None:
        """Reports at another place, several of them while the leading place was heard of too, are another vessel's."""
        self.rival_times += r.t > self.rival.t
        self.rival = self.rival.with_report(r)
        if not self.told and self.rival_times >= self.p.conflict_min_fixes and self.lead.t > self.rival_since:
            self._tell("identity_conflict", r, self.lead.metres_to(r))
            self.told = True

    def _return(self, r: Place) -> None:
        """It was the leading place that was wrong: the vessel is back where it was before."""
        self._jump(self.prior, self.lead)
        self.lead, self.prior = self.prior, None
        self._follow(r)

    def _stray(self, r: Place) -> None:
        self._jump(self.lead, r)
        self.rival, self.rival_since, self.rival_times, self.told = r, r.t, 1, False

    MOVES = {FOLLOWS: _follow, CORROBORATES: _corroborate, RETURNS: _return, STRAYS: _stray}
