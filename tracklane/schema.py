"""Fixed names of the log format: API calls, log names, enum prefixes."""

from __future__ import annotations

# Fixed values
APIS = [
    "createVehicle", "getVehicle", "updateVehicle", "createDeliveryVehicle", "getDeliveryVehicle", "updateDeliveryVehicle",
    "createTrip", "getTrip", "updateTrip", "createTask", "getTask", "updateTask",
]
UPDATE_APIS = ["updateVehicle", "updateDeliveryVehicle"]

# Log names asked for from a log store, and those of the wider entity search
STORE_LOG_NAMES = [
    "create_vehicle", "update_vehicle", "get_vehicle", "create_trip", "update_trip",
    "create_task", "update_task", "create_delivery_vehicle", "update_delivery_vehicle",
]
SEARCH_LOG_NAMES = [
    "create_vehicle", "update_vehicle", "create_trip", "update_trip", "get_trip",
    "create_delivery_vehicle", "update_delivery_vehicle", "create_task", "update_task", "get_task",
]
ODRD, LMFS = "ODRD", "LMFS"

# Attributes a restricted log may overlay on its parent
RESTRICTED_ATTRIBUTES = [
    "currentRouteSegment", "waypoints", "currentRouteSegmentEndPoint", "pickupPoint",
    "intermediateDestinations", "dropoffPoint", "remainingWaypoints", "vehicleWaypoints",
]

# Vehicle position layers
SENSORS = ["GPS", "NETWORK", "PASSIVE", "ROAD_SNAPPED_LOCATION_PROVIDER", "FUSED_LOCATION_PROVIDER"]
TRIP_STATUS_WEIGHT = {
    "NEW": 30, "ENROUTE_TO_PICKUP": 5, "ARRIVED_AT_PICKUP": 10, "ARRIVED_AT_INTERMEDIATE_DESTINATION": 20,
    "ENROUTE_TO_DROPOFF": 5, "COMPLETE": 30, "CANCELED": 30,
}
NAV_STATUS_WEIGHT = {
    "UNKNOWN_NAVIGATION_STATUS": 5, "NO_GUIDANCE": 5, "ENROUTE_TO_DESTINATION": 5, "OFF_ROUTE": 30,
    "ARRIVED_AT_DESTINATION": 10,
}
