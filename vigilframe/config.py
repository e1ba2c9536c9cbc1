"""Every number, word list and lookup table a decision depends on.

One immutable ``Config`` travels through the operators as literals, so a plan shows the values it
ran with and no configuration table is ever joined.  ``version`` is stamped on every verdict.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date
from types import MappingProxyType

# ---------------------------------------------------------------- fixed values ---
# Values below are fixed by the published behaviour this engine has to reproduce.

DOMAINS = (
    "leave", "deployment", "duty_roster", "transfer", "training",
    "workload", "self_report", "biometric", "voice",
)
SESSION_DOMAINS = ("voice",)
HEAT_DOMAINS = ("duty_roster", "leave", "workload", "deployment", "transfer", "training")

TIER_WEIGHT = {"T1": 1.0, "T2": 0.7, "T3": 0.4}
DOMAIN_TIER = {
    "self_report": "T1",
    "leave": "T2", "duty_roster": "T2", "deployment": "T2", "workload": "T2",
    "transfer": "T3", "training": "T3", "biometric": "T3", "voice": "T3",
}
DOMAIN_SCALE = {
    "leave": 30.0, "duty_roster": 16.0, "deployment": 1.0, "workload": 20.0,
    "transfer": 5.0, "training": 12.0, "self_report": 27.0, "biometric": 1.0,
}

GATES = ("evidence", "consistency", "persistence", "actionability")
GATE_THRESHOLDS = {
    "evidence": 0.65, "consistency": 0.70, "persistence": 0.60, "actionability": 0.50,
}
COMPOSITE_EXPONENTS = {
    "evidence": 0.30, "consistency": 0.30, "persistence": 0.25, "actionability": 0.15,
}

CONFOUNDER_RULES = (
    "unit_op_tempo", "planned_leave_cycle", "scheduled_training", "seasonal_roster", "data_gap",
)
CONFOUNDER_MASS = {
    "unit_op_tempo": 0.70, "planned_leave_cycle": 0.60, "scheduled_training": 0.50,
    "seasonal_roster": 0.45, "data_gap": 0.80,
}
CONFOUNDER_LABEL = {
    "unit_op_tempo": "unit-wide operational tempo",
    "planned_leave_cycle": "planned/sanctioned leave cycle",
    "scheduled_training": "scheduled training commitment",
    "seasonal_roster": "seasonal roster pattern",
    "data_gap": "data gap artefact",
}

ACUTE_ITEMS = {"PHQ9": ("item_9",), "GAD7": (), "MBI_GS9": ()}

# code, title, rationale, topics, authority
PLAYBOOK = (
    ("WLF-REST", "Rest and rotation review",
     "Sustained duty density and denied leave are the two service-record patterns that respond "
     "fastest to a rotation change.",
     ("duty_roster", "consecutive_duty", "workload", "leave"), "unit_welfare"),
    ("WLF-LEAVE", "Leave sanction review with the unit adjutant",
     "Repeated leave denial is actionable at unit level and is one of the few drivers a welfare "
     "officer can resolve the same week.",
     ("leave", "leave_denied"), "unit_welfare"),
    ("WLF-FAMILY", "Family liaison and compassionate posting review",
     "Long deployment away from station combined with transfer churn is a family-separation "
     "pattern, not a duty-load pattern.",
     ("deployment", "transfer", "separation"), "unit_welfare"),
    ("WLF-PEER", "Peer-support conversation (buddy system)",
     "Low-intensity, non-clinical, and the least stigmatising first contact available when the "
     "drivers are broad rather than acute.",
     ("self_report", "workload", "duty_roster", "training"), "unit_welfare"),
    ("WLF-COUNSEL", "Referral to unit counselling cell",
     "A validated instrument above cut-off is a direct, consented signal and warrants a trained "
     "conversation rather than a roster change.",
     ("self_report", "phq9", "gad7", "mbi"), "unit_welfare"),
    ("MH-URGENT", "Same-day contact by the designated mental-health authority",
     "Acute-risk item endorsed on a validated instrument. This routes to a mental-health "
     "authority, never to the commanding officer.",
     ("acute", "phq9_item_9", "clinician_concern"), "mental_health"),
    ("WLF-TRAINING-LOAD", "Training load rescheduling",
     "Training assignments are movable in a way operational duty is not.",
     ("training", "course_load"), "unit_welfare"),
)

# code, drivers, action, outcome, note
PRECEDENTS = (
    ("P-001", ("leave", "duty_roster"), "WLF-LEAVE", "supported",
     "Leave sanction reviewed with the adjutant; two applications had been held pending rather "
     "than refused. Resolved within the week."),
    ("P-002", ("duty_roster", "workload"), "WLF-REST", "supported",
     "Rotation adjusted after 40 consecutive duty days. The pattern did not recur in the "
     "following quarter."),
    ("P-003", ("deployment", "transfer"), "WLF-FAMILY", "supported",
     "Third posting in eighteen months with family at the previous station. Family liaison "
     "arranged; compassionate posting review initiated."),
    ("P-004", ("self_report", "workload"), "WLF-COUNSEL", "already_known",
     "Unit counselling cell was already engaged. The flag added nothing and the case was closed "
     "as duplicate."),
    ("P-005", ("duty_roster", "leave", "workload"), "WLF-REST", "not_supported",
     "Unit was mid-deployment; the whole company showed the same pattern. Raised with the "
     "commanding officer as a rostering matter instead."),
    ("P-006", ("training", "workload"), "WLF-TRAINING-LOAD", "supported",
     "Two overlapping course assignments. One was deferred a cycle."),
    ("P-007", ("self_report",), "WLF-PEER", "declined_contact",
     "Peer-support offered and declined. Consent to welfare contact was subsequently narrowed, "
     "and that is the person's right."),
)

DOMAIN_PROSE = {
    "leave": "the rate at which their leave applications are denied",
    "deployment": "time deployed away from station",
    "duty_roster": "consecutive duty days without a clear break",
    "transfer": "postings in the trailing year",
    "training": "course and training days assigned",
    "workload": "duty hours above unit establishment",
    "self_report": "a voluntary wellness self-assessment",
    "biometric": "their opt-in resting heart-rate trend",
}
DRIVER_WORDS = {
    "leave": "how often your leave applications were denied",
    "duty_roster": "how many consecutive duty days you worked without a clear break",
    "workload": "your duty hours against what the unit is established for",
    "deployment": "how long you have been deployed away from station",
    "transfer": "how many postings you have had in the last year",
    "training": "how many course and training days you were assigned",
    "self_report": "the wellness self-assessment you filled in",
    "biometric": "your opt-in resting heart-rate trend",
    "voice": "a voice session you consented to",
}

# Legal moves of one person's case through a cycle.
LEGAL_STATES = {
    "OBSERVED": ("DEVIATING", "CLEARED"),
    "DEVIATING": ("SCORED", "CLEARED"),
    "SCORED": ("REVIEWED",),
    "REVIEWED": ("GATED",),
    "GATED": ("ESCALATED", "MONITORED", "CLEARED"),
    "ESCALATED": ("CONTACTED", "MONITORED", "CLOSED"),
    "CONTACTED": ("CLOSED",),
    "MONITORED": ("OBSERVED", "ESCALATED", "CLEARED"),
    "CLOSED": (),
    "CLEARED": (),
}

# (role, purpose) -> may an identity be shown
GRANTS = {
    ("welfare_officer", "welfare:screening"): False,
    ("welfare_officer", "welfare:contact"): True,
    ("mental_health_authority", "welfare:screening"): False,
    ("mental_health_authority", "welfare:acute"): True,
    ("commander", "command:aggregate"): False,
    ("personnel", "welfare:self"): True,
    ("auditor", "governance:audit"): False,
}
FORBIDDEN_PURPOSES = (
    "administrative:acr", "administrative:promotion",
    "administrative:posting", "administrative:disciplinary",
)
UNIT_SCOPED_ROLES = ("welfare_officer", "commander")

OUTCOMES = ("supported", "not_supported", "already_known", "declined_contact")

# pattern, kind, confidence
CUES = (
    (r"\bi'?m fine\b", "wellbeing", 0.80),
    (r"\bi'?m ok(ay)?\b", "wellbeing", 0.70),
    (r"\bi'?m alright\b", "wellbeing", 0.70),
    (r"\bnothing (to worry|serious|much)\b", "dismissal", 0.75),
    (r"\bit'?s nothing\b", "dismissal", 0.75),
    (r"\bno (problem|issue)s?\b", "dismissal", 0.65),
    (r"\bi'?m managing\b", "coping", 0.70),
    (r"\bi'?ll (manage|cope|be fine)\b", "coping", 0.70),
    (r"\bgetting (by|on with it)\b", "coping", 0.72),
    (r"\bused to it\b", "normalising", 0.68),
    (r"\bpart of the job\b", "normalising", 0.72),
    (r"\bevery(one|body) (has|goes through)\b", "normalising", 0.65),
    (r"\bjust (tired|a bit tired|stress)\b", "attribution", 0.66),
    (r"\bnot (a )?big deal\b", "dismissal", 0.70),
    (r"\bdon'?t (worry|make a fuss)\b", "deflection", 0.72),
    (r"\bi'?ll (be )?(sort|sorted) it\b", "coping", 0.62),
)
HEDGES = (
    "mostly", "more or less", "i suppose", "i think", "kind of", "sort of",
    "mainly", "generally", "usually", "on the whole", "i guess",
)
CONTRASTS = ("but", "though", "although", "even if", "apart from")
NEGATORS = ("not", "n't", "hardly", "never", "far from", "anything but")
CLAUSE_BREAK = r"[.!?;,]|\b(?:but|though|although|however|still|yet)\b"
ACUTE_PHRASES = (
    r"\bkill myself\b",
    r"\bend (my life|it all)\b",
    r"\btake my own life\b",
    r"\bbetter off (dead|without me)\b",
    r"\bno (point|reason) (in )?(going on|living)\b",
    r"\bcan'?t go on\b",
    r"\bwant to die\b",
    r"\bhurt myself\b",
)

# feature, normal, notable, weight, label
BANDS = (
    ("jitter_local", 0.010, 0.030, 0.20, "pitch perturbation"),
    ("shimmer_local", 0.040, 0.110, 0.16, "amplitude perturbation"),
    ("hnr_db", 18.0, 7.0, 0.18, "harmonic-to-noise ratio"),
    ("f0_range_semitones", 8.0, 2.5, 0.20, "intonation range"),
    ("pause_ratio", 0.30, 0.70, 0.14, "pause fraction"),
    ("speech_rate_sps", 3.6, 1.8, 0.12, "syllable rate"),
)

REVIEWERS = ("risk_advocate", "confounder_check", "welfare_context")
HORIZONS = (7, 30, 60, 90)
PSEUDONYM_ANCHOR = date(2026, 1, 1)
# ------------------------------------------------------------ end of fixed values ---


def _frozen(d: Mapping) -> Mapping:
    return MappingProxyType(dict(d))


@dataclass(frozen=True)
class Config:
    version: str = "2026.09.05-1"

    domain_tier: Mapping[str, str] = field(default_factory=lambda: _frozen(DOMAIN_TIER))
    tier_weight: Mapping[str, float] = field(default_factory=lambda: _frozen(TIER_WEIGHT))
    domain_scale: Mapping[str, float] = field(default_factory=lambda: _frozen(DOMAIN_SCALE))
    heat_domains: tuple[str, ...] = HEAT_DOMAINS

    feature_windows: tuple[int, ...] = (7, 30, 90, 180)
    persistence_windows: tuple[int, int, int] = (7, 30, 90)
    persistence_weights: tuple[float, float, float] = (0.20, 0.45, 0.35)
    baseline_days: int = 180
    baseline_lag: int = 90
    min_observations: int = 10
    min_stdev: float = 0.02
    retention_days: int = 365
    salt_days: int = 90
    intervention_days: int = 45
    annotation_days: int = 90
    sustainable_run: int = 14
    rhythm_days: int = 90

    z_self: float = 2.0
    z_unit: float = 2.0
    breach_z: float = 1.5

    thresholds: Mapping[str, float] = field(default_factory=lambda: _frozen(GATE_THRESHOLDS))
    masses: Mapping[str, float] = field(default_factory=lambda: _frozen(CONFOUNDER_MASS))
    op_tempo_fraction: float = 0.40
    data_gap_fraction: float = 0.20
    evidence_saturation: float = 2.4
    evidence_breadth: int = 3
    evidence_weights: tuple[float, float, float] = (0.50, 0.30, 0.20)
    capacity_floor: float = 0.75
    capacity_span: float = 0.25
    exponents: Mapping[str, float] = field(default_factory=lambda: _frozen(COMPOSITE_EXPONENTS))

    acute_items: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: _frozen(ACUTE_ITEMS))
    acute_minimum: int = 0
    acute_ack_hours: int = 12
    instrument_items: int = 9
    instrument_item_max: int = 3
    instrument_cutoff: int = 10
    points_per_sd: float = 5.0
    recall_days: int = 14

    k_min: int = 5
    epsilon_query: float = 0.5
    epsilon_total: float = 60.0

    psi_freeze: float = 0.25
    psi_bins: int = 10
    psi_floor: float = 1e-4
    min_outcomes: int = 20
    max_step: float = 0.05
    precision_floor: float = 0.70
    missed_ceiling: float = 0.30
    min_surfaced: int = 15
    target_precision: float = 0.70

    clip_norm: float = 1.0
    noise_multiplier: float = 0.8
    min_participants: int = 3
    fed_epsilon_total: float = 8.0
    fed_epsilon_round: float = 1.0

    cues: tuple = CUES
    hedges: tuple[str, ...] = HEDGES
    contrasts: tuple[str, ...] = CONTRASTS
    negators: tuple[str, ...] = NEGATORS
    acute_phrases: tuple[str, ...] = ACUTE_PHRASES
    bands: tuple = BANDS
    hedge_bonus: float = 0.10
    contrast_bonus: float = 0.08
    cue_minimum: float = 0.50
    voiced_minimum: float = 0.25
    frame_seconds: float = 0.6
    gap_window_ms: int = 45_000
    feature_divergence: float = 0.25
    gap_features: int = 2
    gap_divergence: float = 0.22
    gap_assessments: int = 3
    strain_windows: int = 5
    strain_features: int = 4
    strain_divergence: float = 0.45
    strain_coverage: float = 0.60
    shift_sessions: int = 3
    shift_z: float = 1.5
    shift_features: int = 3

    def __post_init__(self):
        if self.persistence_windows[-1] > self.baseline_lag:
            raise ValueError("the baseline must end before the longest scored window starts")
        if abs(sum(self.persistence_weights) - 1.0) > 1e-9:
            raise ValueError("persistence weights must sum to 1")
        missing = [t for t in self.domain_tier.values() if t not in self.tier_weight]
        if missing:
            raise ValueError(f"tiers without a weight: {sorted(set(missing))}")

    @property
    def domains(self) -> tuple[str, ...]:
        return tuple(self.domain_tier)

    @property
    def history_days(self) -> int:
        """Days of history a run needs: the lagged baseline reaches back furthest."""
        return max(self.baseline_days + self.baseline_lag, *self.feature_windows)

    def but(self, **changes) -> Config:
        return replace(self, **changes)

    def scale_of(self, domain: str) -> float:
        scale = self.domain_scale.get(domain)
        if scale is None or scale <= 0:
            raise ValueError(f"domain {domain!r} has no positive full-scale value")
        return scale
