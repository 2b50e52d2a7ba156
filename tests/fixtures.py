"""Bulletins of both layouts, made from the grammar the parser accepts."""

A = """ Location : 51201      (21.67N 158.12W)
 Model    : fixture
 Cycle    : 20250130 18 UTC

+-------+-----------+-----------------+-----------------+
| day & |  Hst  n x |    Hs   Tp  dir |    Hs   Tp  dir |
|  hour |  (m)  - - |    (m)  (s) (d) |    (m)  (s) (d) |
+-------+-----------+-----------------+-----------------+
| 30 18 |  2.11  3  |   1.30 10.1 310 | * 0.75 14.2  20 |   0.42  5.0 359 |                 |                 |                 |
| 31 21 |  2.10* 2  |                 |   1.05 11.0 180 |                 |                 |                 |                 |
|  1  0 |  *  0     |   1.0   9.0     |   0.50  8.0 90.9 |                |                 |                 |                 |
| 30  6 |  1.00  7  |   0.10  1.0   1 |   0.20  2.0   2 |   0.30  3.0   3 |   0.40  4.0   4 |   0.50  5.0   5 |   0.60  6.0   6 |   0.70  7.0   7 |
| 31 24 |  1.00  1  |   0.10  1.0   1 |
|  x  1 |  1.00  1  |   0.10  1.0   1 |
+-------+-----------+-----------------+-----------------+
"""
B = """Cycle    : 20250308 12 UTC
Location : 44025      (40.25N 73.16W)
Hr  a b c d e  swells
0 1 2 3 4 5 1.30 10.1 310 0.75 14.2 20 0.42 5.0 359 0.50 8.0 90 0.10 1.0 1 0.20 2.0 2 2.11
18.5 1 2 3 4 5 1.30* 10.1 310 * 0.75 14.2 20 n/a 0.42 5.0 359 0.50 8.0 90 0.10 1.05
21 1 2 3 4 5 1.30 10.1 310
24 . . . . . . . . . . . . . . . . . . x
"""
N = None
#: (pos, ts_utc, date, time, swells, combined)
ROWS_A = [
    (8, "2025-01-30 18:00:00", "Thursday, January 30, 2025", "8:00 AM", [(4.27, 10.1, 130), (2.46, 14.2, 200), (1.38, 5.0, 179), N, N, N], 6.92),
    (9, "2025-01-31 21:00:00", "Friday, January 31, 2025", "11:00 AM", [(3.44, 11.0, 0), N, N, N, N, N], 6.89),
    (10, "2025-02-01 00:00:00", "Friday, January 31, 2025", "2:00 PM", [N, (1.64, 8.0, 270), N, N, N, N], None),
    (11, "2025-03-30 06:00:00", "Saturday, March 29, 2025", "8:00 PM", [(0.33, 1.0, 181), (0.66, 2.0, 182), (0.98, 3.0, 183), (1.31, 4.0, 184), (1.64, 5.0, 185), (1.97, 6.0, 186)], 3.28),
]
ROWS_B = [
    (3, "2025-03-08 12:00:00", "Saturday, March 8, 2025", "7:00 AM", [(4.27, 10.1, 130), (2.46, 14.2, 200), (1.38, 5.0, 179), (1.64, 8.0, 270), (0.33, 1.0, 181), (0.66, 2.0, 182)], 6.92),
    (4, "2025-03-09 06:30:00", "Sunday, March 9, 2025", "1:30 AM", [(4.27, 10.1, 130), (2.46, 14.2, 200), (1.38, 5.0, 179), (1.64, 8.0, 270), N, N], 3.44),
    (6, "2025-03-09 12:00:00", "Sunday, March 9, 2025", "8:00 AM", [N] * 6, 78.74),
]
