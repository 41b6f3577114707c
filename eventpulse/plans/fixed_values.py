"""Weights, caps, bands, limits and labels of the event's scores and segments, as the queries pass them on."""

from __future__ import annotations

from eventpulse.operators.rules import Score, Term

RELEVANCE = Score(
    terms=[
        Term(45, when=[("event_count", ">", 0)]),
        Term(5, column="event_count", cap=30),
        Term(15, when=[("title_event_count", ">", 0)]),
        Term(4, column="n_terms", cap=16),
        Term(10, when=[("chars", ">=", 600)]),
        Term(2, column="experience", cap=10),
        Term(-15, when=[("mixed", ">=", 5), ("event_count", "<=", 1)]),
    ],
    ceiling=([("event_count", "<=", 0)], 45),
)
RELEVANCE_LEVELS = [
    ("confirmed_body_strong", [("event_count", ">=", 2), ("relevance", ">=", 70)]),
    ("confirmed_body_basic", [("event_count", ">", 0), ("relevance", ">=", 55)]),
    ("confirmed_body_weak", [("event_count", ">", 0)]),
    ("needs_review_title_only", [("title_event_count", ">=", 1)]),
]
NO_RELEVANCE = "needs_review_no_body_event_keyword"

DEPTH = Score(
    terms=[Term(4, column="experience", cap=25), Term(2, column="detail", cap=20), Term(3, column="reflection", cap=15), Term(3, column="n_terms", cap=10)],
    bands=[("chars", [(1800, 35), (1000, 28), (600, 20), (300, 12), (1, 5)])],
)
DEPTH_LABELS = [("high_depth", [("depth", ">=", 70)]), ("medium_depth", [("depth", ">=", 45)]), ("low_depth", [("depth", ">=", 25)])]
NO_DEPTH = "thin_reference"

EMOTION = Score(terms=[Term(4, column="positive", cap=45), Term(3, column="negative", cap=20), Term(2, column="reflection", cap=20), Term(3, column="marks", cap=15)])
TONES = [
    ("negative_or_disappointed", [("negative", ">=", 3), ("negative", ">=", "positive")]),
    ("very_positive", [("positive", ">=", 10)]),
    ("very_positive", [("emotion", ">=", 65)]),
    ("positive", [("positive", ">=", 3)]),
    ("mixed", [("positive", ">", 0), ("negative", ">", 0)]),
]
NO_TONE = "neutral_or_unclear"

RISKS = [
    ("high", [("mixed", ">=", 5), ("event_count", "<=", 2)]),
    ("medium", [("mixed", ">=", 3), ("event_count", "<=", 1)]),
    ("medium", [("mixed", ">=", 2), ("event_count", "=", 0), ("chars", ">=", 600)]),
]
NO_RISK = "low"
POST_TYPES = [
    ("title_only_or_extraction_gap", [("event_count", "=", 0)]),
    ("mixed_context_event_mention", [("mixed", ">=", 5), ("event_count", "<=", 2)]),
    ("official_or_promotional_notice", [("promo", ">=", 4), ("experience", "<=", 2)]),
    ("immersive_participant_review", [("depth", ">=", 70), ("emotion", ">=", 55)]),
    ("participant_experience_review", [("depth", ">=", 45), ("experience", ">=", 3)]),
    ("space_or_program_overview", [("detail", ">=", 8)]),
]
NO_POST_TYPE = "event_reference_or_light_review"
#: Whichever holds asks for a look by hand.
REVIEWS = [[("relevance_level", "starts", "needs_review")], [("mixed", ">=", 5), ("event_count", "<=", 2)], [("mixed", ">=", 5), ("event_count", "<=", 2), ("event_count", ">", 0)]]

#: A segment by the best score and the share of places taken.
SEGMENTS = [
    ("expand_or_repeat_candidate", [("best_score", ">=", 70), ("fill", ">=", 0.85)]),
    ("message_or_schedule_review", [("best_score", ">=", 70), ("fill", "<", 0.5)]),
    ("small_capacity_or_niche_strength", [("best_score", "<", 70), ("fill", ">=", 0.85)]),
    ("demand_development_candidate", [("fill", "<", 0.5)]),
]
NO_SEGMENT, NO_FILL = "steady_middle", "capacity_missing"

#: Rules of settlement (low, high, label, rate) and of packages.
RATE_BANDS = [(1, 9, "1-9", 0.75), (10, 99, "10-99", 0.65), (100, None, "100+", 0.55)]
PACKAGES = [(1, 50, "small", None), (51, 200, "medium", None), (201, None, "large", None)]
