"""Table layouts. Coordinates are plain doubles in degrees (lon, lat)."""

STOPS = "pointid string, stop_name_fr string, stop_name_nl string, lon double, lat double"
LINE_STOPS = "lineid string, direction string, sequence_idx int, pointid string, destination string"
LINE_TERMINUS = "lineid string, terminus_pointid string, direction string, destination string"
LINE_SHAPES = ("lineid string, direction string, variant int, mode string, "
               "route_color string, route_text_color string")
# One row per polyline vertex; a line's geometry is never held as one value.
SHAPE_POINTS = "lineid string, direction string, seq int, lon double, lat double"
PINGS = ("position_id string, lineid string, direction string, pointid string, "
         "distance_from_point double, fetched_at_text string")
POSITIONS = ("position_id string, vehicle_uuid string, lineid string, direction int, pointid string, "
             "distance_from_point double, fetched_at timestamp, lon double, lat double")
TRIPS = ("trip_id string, vehicle_uuid string, lineid string, direction int, start_ts timestamp, "
         "end_ts timestamp, point_count int, line_trip_id string, daily_trip_seq int")
TRIP_SAMPLES = "trip_id string, lineid string, direction int, ts timestamp, lon double, lat double"
WAITING_TIMES = ("poll_ts timestamp, pointid string, lineid string, expected timestamp, "
                 "destination string, message string")
