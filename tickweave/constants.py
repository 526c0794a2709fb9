"""Fixed values and defaults.

Everything under "FIXED VALUES" must equal what the reference dashboard uses, because the
results depend on it; the lists are written out as text in the reference's own order.
"""

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (must match the reference dashboard)
# ---------------------------------------------------------------------------------------------

# Market-overview indices, display name -> provider code, in display order.
INDICES = [
    ("Nifty 50", "^NSEI"),
    ("Sensex", "^BSESN"),
    ("Nifty Bank", "^NSEBANK"),
    ("Nifty IT", "^CNXIT"),
    ("Nifty FMCG", "^CNXFMCG"),
    ("Nifty Pharma", "^CNXPHARMA"),
    ("Nifty Auto", "^CNXAUTO"),
    ("Nifty Metal", "^CNXMETAL"),
    ("Nifty Realty", "^CNXREALTY"),
]

# Selectable stocks per exchange, in selection-list order.
TOP_NSE = [
    "RELIANCE.NS", "TCS.NS", "HDFCBANK.NS", "INFY.NS", "HINDUNILVR.NS",
    "ICICIBANK.NS", "SBIN.NS", "BHARTIARTL.NS", "ITC.NS", "LT.NS",
    "KOTAKBANK.NS", "ASIANPAINT.NS", "AXISBANK.NS", "MARUTI.NS", "SUNPHARMA.NS",
    "TITAN.NS", "NESTLEIND.NS", "BAJFINANCE.NS", "NTPC.NS", "POWERGRID.NS",
]
TOP_BSE = [
    "RELIANCE.BO", "TCS.BO", "HDFCBANK.BO", "INFY.BO", "HINDUNILVR.BO",
    "ICICIBANK.BO", "SBIN.BO", "BHARTIARTL.BO", "ITC.BO", "LT.BO",
    "KOTAKBANK.BO", "ASIANPAINT.BO", "AXISBANK.BO", "MARUTI.BO", "SUNPHARMA.BO",
    "TITAN.BO", "NESTLEIND.BO", "BAJFINANCE.BO", "NTPC.BO", "POWERGRID.BO",
]

# Indicator windows and constants.
RSI_PERIOD = 14
MA_WINDOWS = (20, 50, 200)
VOLATILITY_WINDOW = 20
TRADING_DAYS_PER_YEAR = 252
AVG_VOLUME_WINDOW = 20
WEEKS52_ROWS = 252

# Forecast procedure.
DEFAULT_LOOK_BACK = 30          # slider 10..60
LOOK_BACK_RANGE = (10, 60)
DEFAULT_EPOCHS = 20             # 5..100
EPOCHS_RANGE = (5, 100)
DEFAULT_BATCH_SIZE = 32         # one of 8, 16, 32, 64, 128
BATCH_SIZES = (8, 16, 32, 64, 128)
TRAIN_FRACTION = 0.8
FORECAST_STEPS = 30

# Trade rule thresholds and texts.
MAPE_RELIABLE_BELOW = 5.0
CHANGE_BAND = 2.0
CALL_FACTOR = 1.02
PUT_FACTOR = 0.98
RSI_DEFAULT = 50.0
ACTION_CALLS = "Buy Calls ~₹"
ACTION_HOLD = "Hold / Avoid Options"
ACTION_PUTS = "Buy Puts ~₹"
ACTION_UNRELIABLE = "Unreliable - Avoid Trades"

# Strike steps: price below bound -> step; otherwise the last step.
STRIKE_STEPS = [(10.0, 0.5), (100.0, 1.0), (500.0, 5.0)]
STRIKE_STEP_ABOVE = 100.0

# Statement items shown on the P&L view, and the company-profile fields with their default.
PNL_ITEMS = ["Total Revenue", "Net Income"]
PROFILE_FIELDS = ["longName", "sector", "industry", "website", "longBusinessSummary"]
MISSING_TEXT = "N/A"

# News card texts when an article lacks a field.
NO_DESCRIPTION = "No description."
NO_CONTENT = "Full content not available."

# Flow categories of the institutional-activity table.
FLOW_CATEGORIES = ["FII/FPI", "DII"]

# Refresh cadences (seconds) of the three live views.
MARKET_REFRESH_SECONDS = 30
STOCK_REFRESH_SECONDS = 50
FLOW_REFRESH_SECONDS = 300
