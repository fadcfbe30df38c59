"""Explicit schemas of every artifact; JSON is never inferred."""

META = "src string, width int, height int, fps double, n_frames int"
HOMOGRAPHIES = "H array<array<array<double>>>, inliers array<int>, method string, reference_frame int, direct_inliers array<int>, temporal_smoothing boolean, lk_inliers array<int>, keyframes array<int>, keyframe_edge_inliers map<string,int>, keyframe_refine_inliers map<string,int>, blur array<double>, low_inlier_frames array<int>, deck_mask boolean, refined boolean, anchored boolean"
TRACKS = "model string, imgsz int, conf double, max_det int, tiles array<int>, tile_overlap double, tracks array<struct<id:int,cls:string,obs:array<array<double>>>>"
FLOW = "car_len_px double, dt double, erode_frac double, fb_err_px double, spread_max double, bias array<array<double>>, tracks array<struct<id:int,frames:array<int>,vx:array<double>,vy:array<double>,n:array<int>,spread:array<double>,jac:array<double>>>"
WORLD = "car_len_px double, v_stop double, v_move double, velocity_fusion boolean, zv_bias struct<n_static:int,b:array<array<double>>,mad:array<double>>, tracks array<struct<id:int,cls:string,static:boolean,frames:array<int>,x:array<double>,y:array<double>,speed:array<double>,zv_mag:array<double>,zv_med:array<double>,runs:array<array<int>>>>, stop_events array<struct<track:int,frame:int,t:double,t_wav:double,x:double,y:double>>"
CENTERLINE = "source_track int, length_px double, x array<double>, y array<double>"
ROADS = "cell_px int, roads array<struct<id:int,cells:int,n_obs:int,x:array<double>,y:array<double>,lanes:array<double>,lane_halfwidth:double,boundaries:array<double>>>"
SEGMENTS = "segments array<struct<road:int,polygon:array<array<double>>>>"
INTERSECTION = "approaches array<struct<name:string,dir:array<double>,in_line:array<array<double>>,out_line:array<array<double>>,queue_poly:array<array<double>>,signal:struct<phases:array<struct<t0:double,t1:double,state:string>>>>>"
FOCUS = "road int, offset_band array<double>, max_dist double, include array<int>, exclude array<int>, no_backfill array<int>"
MANUAL = "tracks array<struct<id:int,points:array<array<double>>>>"
OVERRIDES = "overrides array<struct<track:int,frame:int,state:string>>"
POLYGONS = "zones array<struct<polygon:array<array<double>>>>"
METRICS = "label string, method string, m1 double, m2 double, m3 double"
STATES = ("rolling", "braking", "stopped")
