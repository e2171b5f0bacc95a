"""Thresholds of the layout operators, in points unless stated."""

from __future__ import annotations

# They are part of what the operators mean.
COVERED = 0.55  # share of a line's area that a box must cover to take it
GUTTER_SHARE = 0.6  # share of the rows of an arity that must vote for a gutter
DISTINCTIVE_CHARS, VOTING_LINES = 12, 5  # lines that vote for a page, and how many of them
PAIR_LEFT, PAIR_RIGHT, PAIR_GAP = 12.0, 3.5, 12.0  # two halves of a row
PAIR_RIGHT_SHARE, PAIR_LEFT_SHARE, PAIR_MOST = 0.30, 0.20, 0.35
SIZE_JUMP = 1.3  # ratio of sizes that ends a paragraph
LEAD_RATIO, LEAD_PLUS, LEAD_DEFAULT = 1.55, 4.0, 12.0  # baseline gap that ends a paragraph
TRACK_LOW, TRACK_HIGH, TRACK_ALPHA, TRACK_UNIFORM = 0.05, 0.24, 0.85, 0.70  # letter spacing: median gap in em, shares
HEADING_RATIO, HEADING_BOLD, HEADING_LINES, HEADING_CHARS = 1.12, 0.60, 3, 200
TOP_ZONE, BOTTOM_ZONE, REPEAT_SHARE, REPEAT_LEAST = 62.0, 64.0, 0.6, 2  # running heads
ROTATED = 0.08  # |sin| of a line that is not horizontal
LABEL_REACH = 46.0  # from a glyph to the line that it marks
MARKER_BASELINE, MARKER_NEAR, MARKER_FAR = 2.5, -1.0, 60.0
ROW_PITCH, TABLE_ROWS, TABLE_COLUMNS, COLUMN_TOL = 60.0, 3, 2, 7.0
FLOW_GAP_LOW, FLOW_GAP_HIGH, FLOW_X, FLOW_SIZE = -2.0, 3.2, 2.5, 0.6
ALIGN_CENTRE, ALIGN_EDGE, ONE_LINE_CENTRE, ONE_LINE_RIGHT = 2.5, 3.0, 8.0, 10.0
BAND_WIDE, BAND_HIGH, BAND_TOP, BAND_FIRST, BAND_NEXT, BAND_LEAST = 0.95, 2.5, 220.0, 36.0, 3.0, 45.0
EDGE_H, EDGE_V = 40.0, 6.0  # least lengths of edges of a grid
CARD_GAP, CARD_WIDE = 4.0, 40.0
RULE_LONG, RULE_SPAN, RULE_BIN = 60.0, 320.0, 8.0
BOX_WIDE, BOX_HIGH, QUOTE_HIGH, QUOTE_THICK, RULE_SHARE, ART_AREA = 30.0, 10.0, 16.0, 1.8, 0.30, 400.0
TOUCH = 6.0  # between drawings of one cluster
FIGURE_REACH, FIGURE_SMALL, FIGURE_WIDE, FIGURE_LEAST, FIGURE_INSIDE = 14.0, 45.0, 1.06, 60.0, 0.80
FIGURE_TIMES, FIGURE_PAGE, FIGURE_ROUNDS, FIGURE_TEXT, FIGURE_PAD = 4.0, 0.55, 6, 0.35, 2.0
MARGIN_TOL, MARGIN_MASS, MARGIN_EXACT, MARGIN_DEFAULT = 2.5, 0.08, 0.02, 72.0
