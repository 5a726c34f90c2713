"""Fixed values of the sales contract.

Everything in this module is a value the results depend on: column lists,
missing-value tokens, date formats, decision thresholds, month names and the
narrative templates' constant sentences. Keep them together so a change of
contract is a change of one file.
"""

from __future__ import annotations

# --- fixed values: canonical sales contract (15 required columns, in order) ---
REQUIRED_COLUMNS = [
    "date",
    "store_id",
    "product_id",
    "category",
    "region",
    "inventory_level",
    "units_sold",
    "units_ordered",
    "demand_forecast",
    "price",
    "discount",
    "weather_condition",
    "holiday_promotion",
    "competitor_pricing",
    "seasonality",
]

# --- fixed values: columns coerced to numbers during cleaning ---
NUMERIC_COLUMNS = [
    "inventory_level",
    "units_sold",
    "units_ordered",
    "price",
    "discount",
    "competitor_pricing",
]

# demand_forecast is carried as text by the original cleaning step; we coerce
# it as well so the processed table has one numeric type per measure.
EXTRA_NUMERIC_COLUMNS = ["demand_forecast"]

# --- fixed values: columns the analytics stage needs ---
ANALYTICS_COLUMNS = ["units_sold", "category", "region"]

# --- fixed values: text cells read as missing (pandas read_csv defaults) ---
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# --- fixed values: accepted date layouts, tried in this order (day first) ---
DATE_FORMATS = [
    "yyyy-MM-dd",
    "d/M/yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "yyyy/M/d",
    "d/M/yy",
    "d-M-yy",
    "d.M.yy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "d-MMM-yy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
]

# --- fixed values: a time of day behind a date (it doesn't change the day) ---
TIME_PART = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?: ?[AaPp][Mm])?)? *(?:Z|UTC|[+-]\d{2}:?\d{2})?$"

# --- fixed values: promotion flag truth tokens (lower-cased text) ---
PROMOTION_TRUE_TOKENS = ["yes", "true", "1"]

# --- fixed values: price column candidates, first hit wins ---
PRICE_CANDIDATES = ["unit_price", "price", "selling_price", "Unit Price"]

# --- fixed values: outlier fence ---
FENCE_LOW_Q = 0.25
FENCE_HIGH_Q = 0.75
FENCE_K = 1.5

# --- fixed values: forecast rules ---
FORECAST_STEPS = 6
CONFIDENCE_LOW = 0.02
CONFIDENCE_MEDIUM = 0.05
STRENGTH_STRONG = 0.05
RANGE_LOW = 0.95
RANGE_HIGH = 1.05

# --- fixed values: report modes ---
OPERATIONS = ["forecasting", "business_analysis"]

# --- fixed values: business rules ---
GAP_UNBALANCED = 50000
REPORT_GAP_STABLE = 10000
SHARE_DOMINANT = 40
SHARE_WEAK = 10
TOP_K = 3

# --- fixed values: month names, 1..12 ---
MONTH_NAMES = [
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
]

# --- fixed values: labels used by decision rules ---
TREND_UP = "increasing"
TREND_DOWN = "decreasing"
GROWTH_UP_TEXT = "Increasing 📈"
GROWTH_DOWN_TEXT = "Decreasing 📉"
RISK_DECLINING = "Declining Demand ⚠️"
RISK_STABLE = "Stable Demand ✅"
HEALTH_UNBALANCED = "Unbalanced ⚠️"
HEALTH_STABLE = "Stable ✅"
REPORT_HEALTH_STABLE = "Business Health: Stable"
REPORT_HEALTH_VARIANCE = "High Variance"
CURRENCY_SYMBOL = "₹"
NOT_AVAILABLE = "N/A"

# --- fixed values: narrative sentences with places for values ---
FORECAST_TREND_INSIGHT = "Sales are showing a {trend} trend over time."
FORECAST_GROWTH_INSIGHT = "Average monthly growth is {growth}%."
FORECAST_BEST_INSIGHT = "Highest sales recorded in {best}."
FORECAST_WORST_INSIGHT = "Lowest performance observed in {worst}."
FORECAST_PEAK_INSIGHT = "Peak sales months are {months}."
FORECAST_CONFIDENCE_INSIGHT = "Forecast confidence is {confidence}, indicating prediction reliability."
BUSINESS_TOP_CATEGORY_INSIGHT = "{category} contributes {share}% of total sales."
BUSINESS_LOW_CATEGORY_INSIGHT = "{category} is underperforming with only {share}% share."
BUSINESS_TOP_REGION_INSIGHT = "{region} region dominates with {share}% of total sales."
BUSINESS_LOW_REGION_INSIGHT = "{region} region has the lowest contribution at {share}%."
BUSINESS_GAP_INSIGHT = "There is a performance gap of {gap} units between top and lowest category."
BUSINESS_DOMINANT_INSIGHT = "{category} dominates heavily → business dependency risk."
BUSINESS_WEAK_INSIGHT = "{category} has very low contribution → consider restructuring."
BUSINESS_INVEST_RECOMMENDATION = "Increase investment in {category} to maximize returns."
BUSINESS_IMPROVE_RECOMMENDATION = "Improve strategy for {category} category to boost performance."
BUSINESS_EXPAND_RECOMMENDATION = "Expand operations in {region} region."
BUSINESS_INVESTIGATE_RECOMMENDATION = "Investigate low demand in {region} region."

# --- fixed values: constant narrative sentences ---
FORECAST_RECOMMENDATIONS = [
    "Adjust inventory based on upcoming demand forecast.",
    "Focus marketing efforts during high-performing months.",
    "Investigate causes behind low-performing periods.",
    "Prepare for demand fluctuations using forecast trends.",
]
FORECAST_CLOSING_INSIGHT = (
    "Forecast is based on past sales trends and assumes similar future conditions."
)
NO_TREND_INSIGHT = "Sales history is too short or uneven to show a trend."
NO_GROWTH_INSIGHT = "Average monthly growth is not available."
NO_CONFIDENCE_INSIGHT = "Forecast confidence is not available."
BUSINESS_SPREAD_INSIGHT = (
    "Sales distribution varies significantly across categories and regions."
)
BUSINESS_FIXED_RECOMMENDATIONS = [
    "Optimize inventory allocation based on category and region demand.",
    "Focus marketing efforts on high-performing segments.",
]
PREPROCESSING_NOTES = [
    "Duplicate rows removed",
    "Missing values handled using imputation",
    "Outliers detected and treated",
    "Date columns standardized",
    "New features created (month, region, category)",
    "Data validated for consistency",
]

# --- fixed values: run-log line layout "ts | LEVEL | RUN_ID=xxxxxxxx | message" ---
RUN_LOG_TS_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
RUN_LOG_PATTERN = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \| ([A-Z]+) \| "
    r"(?:RUN_ID=([0-9A-Za-z]+) \| )?(.*)$"
)
