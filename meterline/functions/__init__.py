from meterline.functions.labels import (model_label, project_label, project_short_name,
                                        short_file_label, is_real_model)
from meterline.functions.timefns import (date_key, month_key, floor_hour, week_start_first_monday,
                                         first_monday_week, iso_week_key, reset_time_label)

__all__ = ["model_label", "project_label", "project_short_name", "short_file_label",
           "is_real_model", "date_key", "month_key", "floor_hour", "week_start_first_monday",
           "first_monday_week", "iso_week_key", "reset_time_label"]
