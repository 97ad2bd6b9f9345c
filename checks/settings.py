"""Parameters shared by the Spark queries and the SQL they are compared with."""

SCENARIO = ("1999-01-03", "1999-12-26")
HISTORY = ("1996-03-06", "2000-10-18")
MEASURE = "blended_total"
PRODUCT = ("Brand#7", "BUILDING")
PRICE_SHIFT = -15.0
PROMO_SHIFT = 0.05
RAW_ITERS, BURN_IN = 30, 0

# Two coefficients (intercept, quantity), so that SQL can use closed forms.
P2 = dict(p=2, df1=4, prior_mean=[0.5, 0.01], prior_precision=[0.1, 0.2], deflator=2.0,
          seed=11)
ITERATIONS = 4
# A fixed coefficient vector for operators that only apply one.
FIXED_B = [9.0, 0.02]
# Planner rows entered by hand: week, num_colors, price, promo_pct, redline_pct.
LEVERS = [("1999-01-03", 4.0, 1200.0, 0.30, 0.10), ("1999-04-04", 5.0, 900.0, 0.60, 0.20),
          ("1999-08-01", 6.0, 1100.0, 0.45, 0.15), ("1999-12-19", 8.0, 1500.0, 0.20, 0.05)]
EPS = 0.1234567
