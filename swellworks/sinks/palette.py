"""Colours of the table view: (header, sub-header, data) of each group and of the combined height, fixed values."""

GROUPS = [
    ("C00000", "F8B4B4", "F9DCDC"),
    ("ED7D31", "FBE5D6", "FDE7D4"),
    ("FFC000", "FFF2CC", "FFF9E5"),
    ("00B050", "D5E8D4", "EAF3E8"),
    ("00B0F0", "D9EAF6", "ECF5FB"),
    ("92D050", "E2F0D9", "F2F8EE"),
]
COMBINED = ("7030A0", "D9D2E9", "EDE9F4")
COLUMNS = 2 + 3 * len(GROUPS) + 1
