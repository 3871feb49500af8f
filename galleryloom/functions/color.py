"""Fixed values of the colour tones."""

from __future__ import annotations

# The tone names, and the hue in degrees at which each chromatic tone ends.
TONES = ["Black", "White", "Gray", "Red", "Orange", "Yellow", "Green", "Cyan", "Blue", "Purple", "Pink"]
HUE_ENDS = [("Red", 15.0), ("Orange", 45.0), ("Yellow", 65.0), ("Green", 150.0), ("Cyan", 210.0),
            ("Blue", 270.0), ("Purple", 300.0), ("Pink", 345.0)]
BLACK_BELOW_VALUE = 0.15
GREY_BELOW_SATURATION = 0.12
WHITE_ABOVE_VALUE = 0.85

# Plot colour of each tone.
TONE_COLORS = {
    "Black": (0.05, 0.05, 0.05),
    "White": (0.98, 0.98, 0.98),
    "Gray": (0.6, 0.6, 0.6),
    "Red": (0.9, 0.2, 0.2),
    "Orange": (0.95, 0.5, 0.1),
    "Yellow": (0.97, 0.9, 0.2),
    "Green": (0.2, 0.7, 0.3),
    "Cyan": (0.1, 0.7, 0.8),
    "Blue": (0.2, 0.3, 0.9),
    "Purple": (0.6, 0.3, 0.8),
    "Pink": (0.95, 0.6, 0.8),
}
